"""Alignment of two tokenizations of the same texts, with corpus-wide counts of linked id pairs.

Each text is encoded by a byte-level BPE (A, on a space and the text) and by
a SentencePiece model (B, which adds the space itself). A token stands for
bytes: A's entry decoded from the byte-level alphabet, B's piece in UTF-8 with
U+2581 as a space and ``<0xHH>`` as byte HH. Byte offsets where an A token and
a B token both end cut a text into groups; an A and a B token occurrence are
linked when their byte ranges overlap.

The work per batch of texts stays in arrays: both token lists of the texts that
are spelled are flattened, token ends are cumulative sums of byte lengths and
marked on one line of bytes per side (ends met on both sides cut groups; every
end of either side closes one link, whose tokens are the next A and the next B
end), sorted keys count links per text and pairs per batch, and the written
groups are looked up id by id. Spark sums the batches' pair counts, finds each
A id's highest count and joins them back to the links of each text.

Defined results: a text that is null or empty, or whose A or B bytes do not
join to the space and the text, has no tokens: all counts 0 and
``groups_sha256`` ''. Such texts take no part in the counts. Repeated rows are
separate documents and each counts; a null id stays null; an empty table
gives no rows; only the id and text columns are read. Very long texts are
encoded whole.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import tokens
from tidemark.llm.common import Scratch
from tidemark.llm.packing import PATTERN

BROADCAST_PAIRS = 2_000_000  # tables of linked id pairs up to this many rows go to every task; larger ones are joined by shuffle
ROW_BITS = 40  # a task's number sits above this bit of a text's row key

OUT = pa.schema([
    ("kind", pa.int8()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("k", pa.int64()),
])
OUT_DDL = ("kind byte, row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "a int, b int, k long")
DOC, LINKS, COUNTS = 0, 1, 2


def _joined(parts: list[bytes], ids: list[int]) -> bytes:
    return b"".join(map(parts.__getitem__, ids))


@functools.lru_cache(maxsize=4)
def _written(size_a: int, size_b: int) -> list[bytes]:
    """What stands in a text's groups for an A id inside a group, an A id before the bar, a B id inside and a B id at the end of a group."""
    return [b"%d%s" % (i, mark) for size, marks in ((size_a, (b",", b"|")), (size_b, (b",", b";"))) for mark in marks for i in range(size)]


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each occurs."""
    values = np.sort(values)
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    return values[starts], np.diff(np.r_[starts, len(values)])


def align_batch(texts: list[str | None], a_path: str, b_path: str, pattern: str = PATTERN) -> tuple[dict, pa.Table, pa.Table]:
    """Per text (n_a, n_b, n_groups, n_links, groups_sha256), its links with counts (doc, a, b, k) and the batch's pair counts (a, b, k)."""
    model_b = tokens.piece_model(b_path)
    a_bytes, b_bytes = tokens.byte_bpe_bytes(a_path), tokens.piece_bytes(b_path)
    a_sizes, b_sizes = tokens.byte_sizes(tokens.byte_bpe_bytes, a_path), tokens.byte_sizes(tokens.piece_bytes, b_path)
    plain = ["" if t is None else t for t in texts]
    a_ids = tokens.encode_bytes_bpe(a_path, pattern, [" " + t for t in plain], plain_specials=True)
    b_ids = model_b.encode(plain, num_threads=1)
    kept, n_bytes = [], []
    for i, (t, a, b) in enumerate(zip(plain, a_ids, b_ids)):
        want = b" " + t.encode()
        if t and _joined(a_bytes, a) == want and _joined(b_bytes, b) == want:
            kept.append(i)
            n_bytes.append(len(want))
    docs = np.array(kept, np.int64)
    n_a, n_b = (np.array([len(ids[i]) for i in kept], np.int64) for ids in (a_ids, b_ids))
    flat_a, flat_b = (np.fromiter(chain.from_iterable(ids[i] for i in kept), np.int64, int(n.sum())) for ids, n in ((a_ids, n_a), (b_ids, n_b)))

    # Both sides spell the same bytes, so ends are places in all kept texts joined; the last of a text is on both sides.
    text_ends = np.cumsum(np.array(n_bytes, np.int64))
    met = np.zeros((2, int(text_ends[-1]) + 1 if kept else 1), bool)
    met[0, np.cumsum(a_sizes[flat_a])] = True
    met[1, np.cumsum(b_sizes[flat_b])] = True
    ends = np.flatnonzero(met[0] | met[1])
    own_a, own_b = met[0, ends], met[1, ends]
    cut = own_a & own_b
    at_a, at_b = np.cumsum(own_a) - own_a, np.cumsum(own_b) - own_b  # the tokens that an end closes, or that go on over it
    last = np.searchsorted(ends, text_ends)  # each text's last link
    n_links, n_groups = np.diff(np.r_[-1, last]), np.diff(np.r_[0, np.cumsum(cut)[last]])

    linked = flat_a[at_a] * len(b_sizes) + flat_b[at_b]
    every = len(a_sizes) * len(b_sizes)
    keys, k = _counted(np.repeat(docs, n_links) * every + linked)
    pair = keys % every
    pairs = pa.table({"doc": keys // every, "a": pair // len(b_sizes), "b": pair % len(b_sizes), "k": k})
    pair, k = _counted(pair)
    counts = pa.table({"a": pair // len(b_sizes), "b": pair % len(b_sizes), "k": k})

    n = len(plain)
    stats = {name: np.zeros(n, np.int64) for name in ("n_a", "n_b", "n_groups", "n_links")}
    for name, values in (("n_a", n_a), ("n_b", n_b), ("n_groups", n_groups), ("n_links", n_links)):
        stats[name][docs] = values
    stats["groups_sha256"] = [""] * n

    # Written form: a group's A ids come after the B ids of all groups before, its B ids after its own A ids.
    closes_a, closes_b = cut[own_a], cut[own_b]
    before_a, before_b = np.r_[0, np.flatnonzero(closes_a) + 1], np.r_[0, np.flatnonzero(closes_b) + 1]  # tokens before each group
    out = np.empty(len(flat_a) + len(flat_b), np.int64)
    out[np.arange(len(flat_a)) + before_b[np.cumsum(closes_a) - closes_a]] = flat_a + closes_a * len(a_sizes)
    out[np.arange(len(flat_b)) + before_a[np.cumsum(closes_b) - closes_b + 1]] = flat_b + 2 * len(a_sizes) + closes_b * len(b_sizes)
    written = _written(len(a_sizes), len(b_sizes))
    bounds = np.r_[0, np.cumsum(n_a + n_b)]
    for i, s, e in zip(kept, bounds, bounds[1:]):
        stats["groups_sha256"][i] = hashlib.sha256(_joined(written, out[s:e].tolist())[:-1]).hexdigest()
    return stats, pairs, counts


def align_texts(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per document.

    ``n_best`` counts the links whose pair count is the highest of their A id
    corpus-wide (ties included); ``count_sum`` sums the pair counts of all links.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "alignment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seen = TaskContext.get().partitionId() << ROW_BITS, 0
        for batch in batches:
            stats, pairs, counts = align_batch(batch.column(1).to_pylist(), a_path, b_path)
            n = batch.num_rows
            rows = np.arange(base + seen, base + seen + n, dtype=np.int64)
            yield pa.RecordBatch.from_pydict({
                "kind": np.full(n, DOC, np.int8), "row": rows, "doc_id": batch.column(0), "n_a": stats["n_a"], "n_b": stats["n_b"],
                "n_groups": stats["n_groups"], "n_links": stats["n_links"], "groups_sha256": stats["groups_sha256"],
                "a": pa.nulls(n, pa.int32()), "b": pa.nulls(n, pa.int32()), "k": pa.nulls(n, pa.int64())}, schema=OUT)
            for part, kind, rowed in ((pairs, LINKS, True), (counts, COUNTS, False)):
                m = len(part)
                if not m:
                    continue
                yield pa.RecordBatch.from_pydict({
                    "kind": np.full(m, kind, np.int8), "row": rows[part["doc"].to_numpy()] if rowed else pa.nulls(m, pa.int64()),
                    "doc_id": pa.nulls(m, pa.int64()), "n_a": pa.nulls(m, pa.int64()), "n_b": pa.nulls(m, pa.int64()),
                    "n_groups": pa.nulls(m, pa.int64()), "n_links": pa.nulls(m, pa.int64()), "groups_sha256": pa.nulls(m, pa.string()),
                    "a": part["a"].chunk(0).cast(pa.int32()), "b": part["b"].chunk(0).cast(pa.int32()), "k": part["k"].chunk(0).cast(pa.int64())}, schema=OUT)
            seen += n

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = scratch.keep("aligned", slim.mapInArrow(run, OUT_DDL))
    per_doc = found.filter(F.col("kind") == DOC).select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    links = found.filter(F.col("kind") == LINKS).select("row", "a", "b", "k")
    counts = found.filter(F.col("kind") == COUNTS).groupBy("a", "b").agg(F.sum("k").alias("count"))
    counts = scratch.keep("counts", counts)
    top = counts.groupBy("a").agg(F.max("count").alias("top"))
    pairs = counts.join(top, "a").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))
    if counts.count() <= BROADCAST_PAIRS:
        pairs = F.broadcast(pairs)
    per_link = links.join(pairs, ["a", "b"]).groupBy("row").agg(
        F.sum(F.col("k") * F.col("count")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("n_best"))
    out = per_doc.join(per_link, "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
                      F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256")
