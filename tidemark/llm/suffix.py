"""Byte-exact removal of repeated strings, by longest-previous-factor arrays over anchored contexts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, in_batches, row_key, texts_of

LENGTH = 200  # bytes of a repeated string
GRAM = 64  # bytes of an anchor
BLOCK = 1 << 20  # string starts that are looked at together
TASK_BYTES = 2 << 20  # contexts that are sorted together
HOT = 4096  # different contexts of one anchor from which on they are split over tasks

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _grams(raw: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every ``size`` bytes (a power of two), built up by doubling."""
    h = (raw.astype(np.uint64) + np.uint64(1)) * _A
    step = 1
    while step < size:
        h = (h[:-step] ^ (h[:-step] >> np.uint64(29))) * _B + (h[step:] ^ (h[step:] >> np.uint64(31))) * _A
        step *= 2
    return h ^ (h >> np.uint64(32))


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(hash, place, first start, last start) of the anchors of a text.

    The anchor of a string of ``length`` bytes is the leftmost of its grams
    with the smallest hash. It depends on the string alone, so equal strings
    have equal anchors at equal distances, wherever they are. Strings that
    follow each other mostly share their anchor; a row here is such a run.
    """
    out = [[np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    width = length - gram + 1
    low = np.uint64((1 << 24) - 1)
    for at in range(0, max(len(text) - length + 1, 0), BLOCK):
        h = _grams(np.frombuffer(text[at : at + BLOCK + length - 1], np.uint8), gram)
        least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if width > span:
            least = np.minimum(least[: span - width], least[width - span :])
        place = (least & low).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        last = np.r_[first[1:], len(place)] - 1
        for column, part in zip(out, (h[place[first]], place[first] + at, first + at, last + at)):
            column.append(part)
    return tuple(np.concatenate(c) for c in out)


def anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(row, place, first, last, anchor, context) of all texts; ``context`` hashes the bytes from the first start to the last end."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            columns: list[list] = [[], [], [], [], [], []]
            for row, text in zip(part.column("row").to_pylist(), texts_of(part, "text")):
                h, place, first, last = anchors(text, length, gram)
                own = [xxhash.xxh64_intdigest(text[a : b + length], p - a) for a, b, p in zip(first.tolist(), last.tolist(), place.tolist())]
                for column, values in zip(columns, (np.full(len(h), row), place, place - first, place - last, h.view(np.int64), np.array(own, np.uint64).view(np.int64))):
                    column.append(values)
            joined = [np.concatenate(c) for c in columns]
            kinds = [np.int64, np.int64, np.int32, np.int32, np.int64, np.int64]
            yield pa.record_batch([pa.array(c.astype(k)) for c, k in zip(joined, kinds)], ["row", "place", "left", "right", "anchor", "context"])

    return in_batches(docs.select("row", "text"), run, "row long, place long, left int, right int, anchor long, context long")


def suffix_ranks(data: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
    """(length, rank of the string of that length at every place) for doubling lengths up to ``depth``."""
    levels, size, rank = [], 1, data.astype(np.int64)
    levels.append((1, rank))
    while size * 2 <= depth:
        count = len(rank) - size
        if count <= 0:
            break
        pair = rank[:count] * (int(rank.max()) + 1) + rank[size:]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        size *= 2
        levels.append((size, rank))
    return levels


def longest_previous(data: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous factor of every start, and the earlier start it is found at (-1: none), lengths up to ``depth``.

    Starts are put in the order of their suffixes. The longest match with an
    earlier start is then the one with the previous or the next smaller place
    in that order, whichever is longer. ``starts`` ascend and have ``depth``
    bytes before the end of ``data``.
    """
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    levels = suffix_ranks(data, depth)
    size, rank = levels[-1]
    keys = [starts]
    for at in sorted({*range(0, depth - size, size), depth - size}, reverse=True):
        keys.append(rank[starts + at])
    order = np.lexsort(keys)
    place = starts[order]
    lpf, source = np.zeros(n, np.int64), np.full(n, -1)
    for side in (-1, 1):
        near = _smaller(place, side)
        have = near >= 0
        match = np.zeros(n, np.int64)
        match[have] = _common(levels, place[have], place[near[have]], depth)
        better = match > lpf
        lpf = np.where(better, match, lpf)
        source = np.where(better, place[near], source)
    back_lpf, back_source = np.empty(n, np.int64), np.empty(n, np.int64)
    back_lpf[order], back_source[order] = lpf, source
    return back_lpf, back_source


def _smaller(place: np.ndarray, side: int) -> np.ndarray:
    """Per element the nearest one before (-1) or after (1) it that is smaller, or -1; by jumping along links."""
    if side > 0:
        flipped = _smaller(place[::-1], -1)[::-1]
        return np.where(flipped < 0, -1, len(place) - 1 - flipped)
    link = np.arange(-1, len(place) - 1)
    open_ = np.arange(len(place))
    while len(open_):
        to = link[open_]
        open_ = open_[(to >= 0) & (place[to] > place[open_])]
        link[open_] = link[link[open_]]
    return link


def _common(levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common beginning of the strings at ``a`` and ``b``, up to ``depth``."""
    done = np.zeros(len(a), np.int64)
    going = np.ones(len(a), bool)  # as long as strings of the largest size are equal
    top = levels[-1][0]
    for size, rank in [levels[-1]] * (depth // top) + levels[-2::-1]:
        x, y = a + done, b + done
        fits = (x < len(rank)) & (y < len(rank)) & (done + size <= depth) & (going if size == top else True)
        same = fits & (rank[np.where(fits, x, 0)] == rank[np.where(fits, y, 0)])
        done += np.where(same, size, 0)
        if size == top:
            going &= same
    return done


def repeated(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, start in it, is first) of every string of ``length`` bytes that is in these contexts more than once."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    base = np.cumsum(sizes) - sizes
    runs = np.maximum(sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(contexts)), runs)
    starts = np.repeat(base - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
    lpf, source = longest_previous(np.frombuffer(b"".join(contexts), np.uint8), starts, length)
    later = lpf >= length
    first = np.isin(starts, source[later]) & ~later
    hit = later | first
    return owner[hit], (starts - base[owner])[hit], first[hit]


def _runs(owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, first, last) of consecutive places."""
    if not len(owner):
        return owner, at, at
    cut = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)])
    last = np.r_[cut[1:], len(owner)] - 1
    return owner[cut], at[cut], at[last]


def resolve(contexts: DataFrame, length: int) -> DataFrame:
    """(anchor, context, first, last, kept_first): runs of repeated strings in contexts that share an anchor but differ.

    Rows are (anchor, context, bytes), ordered by their first appearance within an anchor.
    """
    width = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = contexts.select("anchor", "context", "seen", "bytes").repartition(width, "anchor").sortWithinPartitions("anchor", "seen")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size = 0

        def answer(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            owner, at, first = repeated([r[2] for r in rows], length)
            out = []
            for kind in (False, True):
                o, a, b = _runs(owner[first == kind], at[first == kind])
                out.append((o, a, b, np.full(len(o), kind)))
            o, a, b, f = (np.concatenate(c) for c in zip(*out))
            anchor, context = np.array([r[0] for r in rows])[o], np.array([r[1] for r in rows])[o]
            return pa.record_batch([pa.array(anchor), pa.array(context), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(f)], ["anchor", "context", "first", "last", "kept_first"])

        for part in parts:
            for row in zip(part.column("anchor").to_pylist(), part.column("context").to_pylist(), part.column("bytes").to_pylist()):
                if size > TASK_BYTES and row[0] != held[-1][0]:
                    yield answer(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield answer(held)

    return in_batches(near, run, "anchor long, context long, first int, last int, kept_first boolean")


def resolve_hot(contexts: DataFrame, length: int) -> DataFrame:
    """What ``resolve`` returns, string by string over all tasks, for anchors with very many contexts."""
    starts = F.explode(F.sequence(F.lit(0), F.length("bytes") - length))
    one = contexts.select("anchor", "context", "seen", "distance", "bytes", starts.alias("at"))
    one = one.select("anchor", "context", "seen", "at", (F.col("distance") - F.col("at")).alias("off"), F.expr(f"unhex(md5(substring(bytes, at + 1, {length})))").alias("string"))
    met = one.groupBy("anchor", "off", "string").agg(F.count("*").alias("n"), F.min("seen").alias("least")).filter("n > 1")
    both = one.join(met, ["anchor", "off", "string"])
    return both.select("anchor", "context", F.col("at").cast("int").alias("first"), F.col("at").cast("int").alias("last"), (F.col("seen") == F.col("least")).alias("kept_first"))


def repeated_spans(docs: DataFrame, scratch: Scratch, length: int, gram: int, keep_first: bool, hot: int) -> DataFrame:
    """(row, start, end): byte spans of ``docs`` (row, text) to be removed; they may overlap."""
    rows = scratch.keep("anchors", anchor_rows(docs, length, gram))
    per = rows.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("context") != F.max("context")).alias("differ")).filter("n > 1")
    per = scratch.keep("per", per.select("anchor", "differ"))
    hits = scratch.keep("hits", rows.join(per.hint("merge"), "anchor"))
    scratch.drop("anchors", "per")
    seen = F.min(F.struct("row", "place")).alias("seen")
    kinds = hits.groupBy("anchor", "context").agg(F.count("*").alias("n"), seen, F.first("left").alias("left"), F.first("right").alias("right"), F.first("differ").alias("differ"))
    kinds = scratch.keep("kinds", kinds)
    # A context that is there more than once is repeated as a whole.
    whole = kinds.filter("n > 1").select(
        "anchor", "context", "seen", F.lit(0).alias("first"), (F.col("left") - F.col("right")).alias("last"), F.lit(not keep_first).alias("at_seen"), F.lit(True).alias("elsewhere"))
    # Contexts that differ but share an anchor are compared byte by byte.
    asked = kinds.filter("differ").groupBy("seen.row").agg(F.collect_list(F.struct("anchor", "context", "seen.place", "left", "right")).alias("asked"))
    asked = scratch.keep("asked", asked)
    contexts = scratch.keep("contexts", context_bytes(docs.join(asked.hint("merge"), "row"), length))
    crowds = scratch.keep("crowds", contexts.groupBy("anchor").count().filter(F.col("count") > hot).select("anchor"))
    some = resolve(contexts.join(crowds, "anchor", "left_anti"), length).unionByName(resolve_hot(contexts.join(crowds, "anchor", "left_semi"), length))
    at_seen = ~F.col("kept_first") if keep_first else F.lit(True)
    near = some.join(kinds.select("anchor", "context", "seen"), ["anchor", "context"]).select("anchor", "context", "seen", "first", "last", at_seen.alias("at_seen"), F.lit(False).alias("elsewhere"))
    found = scratch.keep("verdicts", whole.unionByName(near))
    scratch.drop("kinds", "asked", "contexts", "crowds")
    own = (F.col("row") == F.col("seen.row")) & (F.col("place") == F.col("seen.place"))
    met = hits.join(found.hint("merge"), ["anchor", "context"]).filter(F.when(own, F.col("at_seen")).otherwise(F.col("elsewhere")))
    begin = F.col("place") - F.col("left")
    return met.select("row", (begin + F.col("first")).alias("start"), (begin + F.col("last") + length).alias("end"))


def context_bytes(asked: DataFrame, length: int) -> DataFrame:
    """(anchor, context, seen, distance, bytes) of the contexts asked for in each (row, text, asked)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            columns: list[list] = [[] for _ in range(6)]
            for row, text, items in zip(part.column("row").to_pylist(), texts_of(part, "text"), part.column("asked").to_pylist()):
                for i in items:
                    piece = text[i["place"] - i["left"] : i["place"] - i["right"] + length]
                    for column, value in zip(columns, (i["anchor"], i["context"], row, i["place"], i["left"], piece)):
                        column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["anchor", "context", "row", "place", "distance", "bytes"])

    cut = in_batches(asked.select("row", "text", "asked"), run, "anchor long, context long, row long, place long, distance int, bytes binary")
    return cut.select("anchor", "context", F.struct("row", "place").alias("seen"), "distance", "bytes")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch or overlap joined."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def dedup_strings(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_first: bool = True, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT
) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): every row's bytes without strings of ``length`` bytes that are there more than once.

    A string counts if it starts at two places of the input, in one document or
    in two; it never reaches across documents, and strings are judged on the
    input. All bytes that such a string covers go; with ``keep_first`` those of
    its first appearance stay (in order of row hash, then place). ``spans`` are
    the removed byte runs (start, end), maximal; ``kept`` is binary, as a cut
    may fall inside a character. A null text is empty. Repeated rows are
    copies of each other; as they cannot be told apart, ``keep_first`` treats
    the first of them alike. Other columns are ignored; whole texts are read.

    Each string belongs to an anchor that its own bytes choose, so equal
    strings meet. Anchors that occur once end there, equal contexts of an
    anchor are counted, and only contexts that differ are shipped and sorted by
    suffix; an anchor with more than ``hot`` of them is split over tasks.
    """
    if gram & (gram - 1) or not 0 < gram <= length:
        raise ValueError("gram is a power of two of at most length")
    scratch = Scratch(docs.sparkSession, "suffix")
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    slim = slim.withColumn("row", row_key("doc_id", "text"))
    spans = repeated_spans(slim.select("row", "text"), scratch, length, gram, keep_first, hot)
    gone = scratch.keep("gone", spans.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("gone")))
    scratch.drop("hits", "verdicts")
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for part in parts:
            sizes, all_spans, kept = [], [], []
            for text, gone in zip(texts_of(part, "text"), part.column("gone").to_pylist()):
                runs = merged([(g["start"], g["end"]) for g in gone or ()])
                edges = [0, *[x for r in runs for x in r], len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                sizes.append(len(text))
                all_spans.append([{"start": a, "end": b} for a, b in runs])
            yield pa.record_batch([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(all_spans, pairs), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    both = slim.join(gone.hint("merge"), "row", "left").select("doc_id", "text", "gone")
    return in_batches(both, run, f"doc_id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
