"""Near-duplicate documents by SimHash fingerprints and tables of pivot distances."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, in_batches, texts_of
from tidemark.llm.components import components

SEED = 42
PIVOTS = 24  # reference fingerprints of the distance table
CHUNK = 2048  # rows of one bucket that meet in a task


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """SimHash of the word shingles of ``text`` (lower-cased A-Z), as an unsigned 64-bit number.

    Repeats count. A text with fewer words is one shingle; one without words has fingerprint zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        hashes = np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        spans = zip((ends - lengths)[:n].tolist(), ends[shingle - 1 :].tolist())
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(line[a:b], SEED) for a, b in spans), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[at : at + 65_536].view(np.uint8), bitorder="little")
        votes += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row per input row; ``fp`` holds the 64 bits in a signed long."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            marks = np.array([fingerprint(t, shingle) for t in texts_of(part, "text")], np.uint64)
            yield pa.record_batch([part.column("doc_id"), pa.array(marks.view(np.int64))], ["doc_id", "fp"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return in_batches(slim, run, "doc_id long, fp long")


def block_masks(max_bits: int, count: int) -> list[int]:
    """Masks of which two fingerprints at most ``max_bits`` apart agree under at least one.

    The 64 bits are cut into ``b`` blocks. At most ``max_bits`` blocks differ, so
    the other ``b - max_bits`` agree; each choice of that many blocks is a mask.
    ``b`` grows with the number of fingerprints, so that buckets stay small at
    any size; every choice of ``b`` finds the same pairs.
    """
    if max_bits >= 64:
        return [0]
    need = max(count, 2).bit_length() + 2
    blocks = max_bits + 1
    while blocks < 64 and 64 * (blocks - max_bits) // blocks < need and comb(blocks + 1, max_bits) <= 5_000:
        blocks += 1
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in combinations(parts, blocks - max_bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def pivot_table(fps: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Hamming distances of every fingerprint to the reference fingerprints, a row per reference.

    The first reference is zero; the others are fixed pseudo-random numbers.
    """
    refs = np.array([0] + [xxhash.xxh64_intdigest(str(i).encode(), SEED) for i in range(1, pivots)], np.uint64)
    return np.stack([np.bitwise_count(fps ^ r).astype(np.int8) for r in refs])


class _Forest:
    def __init__(self, size: int):
        self.up = np.arange(size)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = int(up[i])
        return i

    def flat(self) -> np.ndarray:
        while True:
            nxt = self.up[self.up]
            if (nxt == self.up).all():
                return nxt
            self.up = nxt


def links(groups: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between fingerprints of one group that are at most ``max_bits`` apart.

    ``groups`` are numbers of consecutive rows. Rows of a group are ordered by
    their distance to the first reference, so that the sweep over growing
    offsets ends where that coordinate alone differs too much; the other
    coordinates of the table discard pairs, and an exact distance verifies the
    rest. Pairs that are connected already are not looked at again.
    """
    order = np.lexsort((fps, np.bitwise_count(fps), groups))
    groups, fps = groups[order], fps[order]
    table = pivot_table(fps)
    forest = _Forest(len(fps))
    left, right = [], []

    def add(i: np.ndarray, j: np.ndarray) -> None:
        for a, b in zip(i.tolist(), j.tolist()):
            x, y = forest.root(a), forest.root(b)
            if x != y:
                forest.up[max(x, y)] = min(x, y)
                left.append(a)
                right.append(b)

    def near(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for row in table[1:]:
            keep = np.abs(row[i] - row[j]) <= max_bits
            i, j = i[keep], j[keep]
            if not len(i):
                return i, j
        keep = np.bitwise_count(fps[i] ^ fps[j]) <= max_bits
        return i[keep], j[keep]

    # The middle row of a group first: in a dense group it links nearly all.
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(groups)])
    hub = np.repeat(starts + sizes // 2, sizes)
    rows = np.arange(len(groups))
    near_hub = (rows != hub) & (np.abs(table[0] - table[0][hub]) <= max_bits)
    add(*near(hub[near_hub], rows[near_hub]))

    ends = np.repeat(starts + sizes, sizes)
    live, step, root = rows, 0, forest.flat()
    while len(live):
        step += 1
        live = live[live + step < ends[live]]
        live = live[table[0][live + step] - table[0][live] <= max_bits]
        open_ = live[root[live] != root[live + step]]
        if len(open_):
            found = near(open_, open_ + step)
            if len(found[0]):
                add(*found)
                root = forest.flat()
    return fps[np.array(left, np.int64)], fps[np.array(right, np.int64)]


def near_links(distinct: DataFrame, max_bits: int, scratch: Scratch, chunk: int = CHUNK) -> DataFrame:
    """(u, v): links that connect all fingerprints of ``distinct`` (fp) at most ``max_bits`` apart.

    Fingerprints that agree under a mask meet in a bucket. A bucket above
    ``chunk`` rows is cut into chunks and each pair of chunks is a task's
    group of its own, so no task holds a whole bucket; a bucket never holds a
    fingerprint twice. No pairs are emitted, only the links of a forest.
    """
    masks = block_masks(max_bits, distinct.count())
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")) for m in masks])).alias("mask", "part"))
    sizes = scratch.keep("sizes", keyed.groupBy("mask", "part").count().filter("count > 1"))
    cut = F.ceil(F.col("count") / F.lit(chunk)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("cut")).cast("int")
    rows = (
        keyed.join(sizes, ["mask", "part"]).withColumn("cut", cut).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
        .select("mask", "part", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp")
    )
    width = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    meet = rows.select(F.xxhash64("mask", "part", "a", "b").alias("bucket"), "fp").repartition(width, "bucket").sortWithinPartitions("bucket")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_b, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        wait: list[tuple[np.ndarray, np.ndarray]] = []

        def answer(b: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            u, v = links(b, f, max_bits)
            return pa.record_batch([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        count = 0
        for part in parts:
            wait.append((part.column("bucket").to_numpy(), part.column("fp").to_numpy().view(np.uint64)))
            count += part.num_rows
            if count < 50_000:
                continue
            b = np.concatenate([held_b, *[w[0] for w in wait]])
            f = np.concatenate([held_f, *[w[1] for w in wait]])
            whole = b != b[-1]  # the last bucket may go on in the next batch
            held_b, held_f, wait, count = b[~whole], f[~whole], [], 0
            if whole.any():
                yield answer(b[whole], f[whole])
        b = np.concatenate([held_b, *[w[0] for w in wait]])
        if len(b):
            yield answer(b, np.concatenate([held_f, *[w[1] for w in wait]]))

    return in_batches(meet, run, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Components of documents whose SimHash fingerprints link at ``max_bits`` or fewer differing bits.

    Returns (doc_id, fp, component_id), one row per input row; the component is
    named by its smallest non-null doc_id. Texts without words (null, empty,
    blank) have fingerprint zero and link like any other. Repeated rows come
    back as often as they came; rows without a doc_id are grouped by their
    text but never name a component. An empty table gives an empty table;
    other columns of ``docs`` are ignored. Every text is read whole. ``chunk``
    bounds what one task compares, not what is found.
    """
    if not 0 <= max_bits <= 64:
        raise ValueError("max_bits is between 0 and 64")
    scratch = Scratch(docs.sparkSession, "simhash")
    marks = scratch.keep("marks", fingerprints(docs, shingle, id_col, text_col))
    distinct = scratch.keep("distinct", marks.groupBy("fp").agg(F.min("doc_id").alias("first")))
    linked = scratch.keep("links", near_links(distinct.select("fp"), max_bits, scratch, chunk))
    named = components(linked, scratch).join(distinct, F.col("node") == F.col("fp"), "right")
    named = scratch.keep("named", named.select("fp", F.coalesce("component", "fp").alias("component"), "first"))
    least = scratch.keep("least", named.groupBy("component").agg(F.min("first").alias("component_id")))
    ids = scratch.keep("ids", named.join(least, "component").select("fp", "component_id"))
    scratch.drop("sizes", "links", "named", "least", "distinct")
    return marks.join(ids, "fp").select("doc_id", "fp", "component_id")
