"""Exact top-k inner products with multi-resolution segment statistics."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import in_batches

QUERY_BLOCK = 4096  # queries of one pass; they travel with its tasks
LEVELS = (1, 4, 16)  # segments, coarse to fine
EXACT = 1 << 53  # whole numbers a double holds exactly


def segments(vectors: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment means and deviations, both times the root of the segment's length."""
    cuts = np.unique(np.linspace(0, vectors.shape[1], count + 1).astype(int))
    means, deviations = [], []
    for a, b in zip(cuts, cuts[1:]):
        part = vectors[:, a:b]
        mean = part.mean(axis=1)
        means.append(mean * np.sqrt(b - a))
        deviations.append(np.sqrt(((part - mean[:, None]) ** 2).sum(axis=1)))
    return np.stack(means, 1), np.stack(deviations, 1)


def best_of_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, floor: np.ndarray, k: int):
    """Per query the ``k`` best rows of a block whose score is ``floor`` or more: (query row, ids, scores).

    |q-x|² is at least, over segments of length n, the sum of n(difference of
    means)² + (difference of root summed squares)². As the norms are known this
    bounds the inner product from above; each level refines the last, and the
    pairs left are scored exactly.
    """
    pairs = q_ids[:, None] != ids[None, :]
    limit = floor.astype(float)[:, None]
    slack = 1e-9 * np.sqrt((q**2).sum(1))[:, None] * np.sqrt((x**2).sum(1))[None, :] + 1e-6
    for level in LEVELS:
        if level >= q.shape[1]:
            break
        (qm, qd), (xm, xd) = segments(q, level), segments(x, level)
        pairs &= qm @ xm.T + qd @ xd.T + slack >= limit
    out = []
    for row in np.flatnonzero(pairs.any(axis=1)):
        at = np.flatnonzero(pairs[row])
        score = (x[at] @ q[row]).astype(np.int64)
        keep = score >= floor[row]
        at, score = at[keep], score[keep]
        if len(at) > k:
            best = np.lexsort((ids[at], -score))[:k]
            at, score = at[best], score[best]
        out.append((row, ids[at], score))
    return out


def whole_vectors(df: DataFrame, vec: Column) -> DataFrame:
    """Rows whose vector is there and holds no null, NaN or infinity."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.filter(vec.isNotNull() & finite)


def top_inner_products(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "vec", block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows with the highest inner product of every query row.

    ``vec_col`` is an array of whole numbers as doubles; scores are exact.
    Ties go to the smaller id; a query never finds rows of its own id, and sees
    rows of its own dimension only. Fewer than ``k`` candidates give fewer
    rows, no candidates none. Rows with a null id or with a vector that is null
    or holds null, NaN or infinity take no part. Repeated rows are candidates
    each; a repeated query id is answered from its first vector in sort order.
    Raises if scores could leave the range of exact doubles.

    Queries travel in blocks of ``block``; each block meets all rows in one
    pass whose tasks keep ``k`` rows per query, so nothing grows but the passes.
    """
    spark = vectors.sparkSession
    vec = F.col(vec_col)
    rows = whole_vectors(vectors.filter(F.col(id_col).isNotNull()), vec)
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), vec.cast("array<double>").alias("vec"), is_query.alias("is_query"))
    queries = rows.filter("is_query").groupBy("vec_id").agg(F.min("vec").alias("vec"))
    total = queries.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    parts = max(1, -(-total // block))
    cut = F.pmod(F.xxhash64("vec_id"), F.lit(parts))
    found = []
    for part in range(parts):
        chosen = queries.filter(cut == part).collect() if parts > 1 else queries.collect()
        by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in {len(r.vec) for r in chosen}:
            same = sorted((r for r in chosen if len(r.vec) == size), key=lambda r: r.vec_id)
            by_size[size] = np.array([r.vec_id for r in same], np.int64), np.array([r.vec for r in same], float).reshape(len(same), size)
        sent = spark.sparkContext.broadcast(by_size)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            kept = {n: ([np.zeros(0, np.int64)] * len(i), [np.zeros(0, np.int64)] * len(i), np.full(len(i), -(1 << 62))) for n, (i, _) in sent.value.items()}
            for batch in batches:
                lists = batch.column("vec")
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                sizes = np.diff(lists.offsets.to_numpy())
                all_ids = batch.column("vec_id").to_numpy()
                starts = np.cumsum(sizes) - sizes
                for n, (q_ids, q) in sent.value.items():
                    at = np.flatnonzero(sizes == n)
                    x = flat[starts[at][:, None] + np.arange(n)[None, :]].reshape(len(at), n)
                    if not len(at):
                        continue
                    if (np.abs(q).max(initial=0) * np.abs(x).max(initial=0)) * max(n, 1) >= EXACT:
                        raise ValueError("vectors are too large for exact scores")
                    best_ids, best_scores, floor = kept[n]
                    for row, ids, scores in best_of_block(q_ids, q, all_ids[at], x, floor, k):
                        ids, scores = np.r_[best_ids[row], ids], np.r_[best_scores[row], scores]
                        order = np.lexsort((ids, -scores))[:k]
                        best_ids[row], best_scores[row] = ids[order], scores[order]
                        if len(order) == k:
                            floor[row] = scores[order[-1]]
            for n, (q_ids, _) in sent.value.items():
                best_ids, best_scores, _ = kept[n]
                lengths = [len(i) for i in best_ids]
                if sum(lengths):
                    yield pa.record_batch([pa.array(np.repeat(q_ids, lengths)), pa.array(np.concatenate(best_ids)), pa.array(np.concatenate(best_scores))], ["query_id", "vec_id", "score"])

        found.append(in_batches(rows.select("vec_id", "vec"), run, "query_id long, vec_id long, score long"))
    near = reduce(DataFrame.unionAll, found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
