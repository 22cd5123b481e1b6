"""Exact k-nearest-neighbour search, classification and k-distances."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.metric import Metric, block_join, build_cells, empty, matrix, pair_distances, places, screened, strips, tiles, upper_bounds, visits
from tidemark.plans.session import materialise


def _top_k(points: pd.DataFrame, queries: pd.DataFrame, k: int, metric: Metric, skip_self: bool) -> pd.DataFrame:
    names = ["qid", "id", "distance"]
    if not len(points) or not len(queries):
        return empty(names)
    points = points.sort_values("id")
    x, ids = matrix(points["x"]), points["id"].to_numpy()
    few = _first_copies(x, k + int(skip_self))
    x, ids = x[few], ids[few]
    q, qids = matrix(queries["x"]), queries["qid"].to_numpy()
    out = []
    for part in strips(len(q)):
        rows, cols, near = _candidates(q[part], x, k, metric, qids[part][:, None] == ids[None, :] if skip_self else None)
        order = np.lexsort((cols, near, rows))
        rows, cols, near = rows[order], cols[order], near[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
        keep = rank < k
        out.append(pd.DataFrame({"qid": qids[part][rows[keep]], "id": ids[cols[keep]], "distance": near[keep]}))
    return pd.concat(out) if out else empty(names)


def _first_copies(x: np.ndarray, k: int) -> np.ndarray:
    """Rows that are among the first ``k`` equal to them; no others can be among k nearest with ties by row."""
    held = np.ascontiguousarray(x + 0.0)
    _, code = np.unique(held.view(np.dtype((np.void, held.shape[1] * held.itemsize))).ravel(), return_inverse=True)
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.arange(len(code)) - np.searchsorted(code, code, side="left") < k
    return np.sort(order[first])


def _candidates(q: np.ndarray, x: np.ndarray, k: int, metric: Metric, never: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and distance of every pair that may be one of a row's ``k`` nearest; the k nearest are among them.

    The k-th least of the first columns bounds the rest. Euclidean distances
    are screened by a product, and only what passes is measured.
    """
    found, limit = [], np.full(len(q), np.inf)
    for _, at in tiles(1, len(x)):
        rough = screened(q, x[at]) if metric.euclidean and q.shape[1] > 2 else None
        value, error = rough if rough is not None else (metric(q, x[at]), np.zeros(len(q)))
        value[np.isnan(value)] = np.inf  # no neighbour
        if never is not None:
            value[never[:, at]] = np.inf
        square = rough is not None
        if value.shape[1] >= k and not np.isfinite(limit).all():
            kth = np.partition(value, k - 1, axis=1)[:, k - 1].astype(float) + error
            limit = np.minimum(limit, kth if square else kth * kth if metric.euclidean else kth)
        bound = limit if square or not metric.euclidean else np.sqrt(limit) * (1 + 1e-12)
        if square:
            bound = np.nextafter((bound + error).astype("float32"), np.float32(np.inf))
        rows, cols = places(np.ascontiguousarray((value <= bound[:, None]) & np.isfinite(value)))
        if square:
            parts = [pair_distances(q[rows[s]], x[at][cols[s]]) for s in (slice(i, i + (1 << 18)) for i in range(0, len(rows), 1 << 18))]
            near = np.concatenate(parts) if parts else np.zeros(0)
        else:
            near = value[rows, cols]
        found.append((rows, cols + at.start, near))
    return tuple(np.concatenate(side) for side in zip(*found))


def nearest_neighbours(
    train: DataFrame,
    queries: DataFrame,
    k: int,
    metric: Metric | None = None,
    train_id: str = "id",
    query_id: str = "qid",
    vector: str = "x",
    skip_self: bool = False,
) -> DataFrame:
    """The ``k`` nearest training points of every query: (qid, id, distance, rank), ties by id.

    First each query searches the cell of its nearest pivot; the distance found
    there then rules out most other cells, and the rest are searched exactly.
    """
    metric = metric or Metric()
    points = train.select(F.col(train_id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    asks = queries.select(F.col(query_id).cast("bigint").alias("qid"), F.col(vector).cast("array<double>").alias("x"))
    cells = build_cells(points, metric)
    schema = "qid long, id long, distance double"

    def kernel(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        return _top_k(p, q, k, metric, skip_self)

    near = Window.partitionBy("qid").orderBy("distance", "id")
    if len(cells.pivots) == 1:
        found = block_join(cells, asks.withColumn("visit", F.lit(0)), kernel, schema)
        return found.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= k)
    home = materialise(block_join(cells, visits(asks, cells, metric, 0.0, own="only"), kernel, schema), "home")
    kth = home.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") == k).select("qid", F.col("distance").alias("found"))
    bounded = upper_bounds(asks, cells, metric, k + int(skip_self)).join(kth, "qid", "left")
    bounded = bounded.withColumn("reach", F.least("bound", F.coalesce("found", F.lit(float("inf"))))).drop("bound", "found")
    away = block_join(cells, visits(bounded, cells, metric, "reach", own="skip").drop("reach"), kernel, schema)
    return home.unionByName(away).withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= k)


def vote(neighbours: DataFrame, labels: DataFrame, weights: str = "uniform", by: Sequence[str] = ("qid",)) -> DataFrame:
    """Majority class of the neighbours and its share; ties go to the smallest class.

    ``labels`` maps a neighbour id to its class. With distance weights a
    neighbour counts 1/d, and exact matches alone decide when there are any.
    """
    keys = list(by)
    known = neighbours.join(labels.select("id", "label"), "id")
    if weights == "distance":
        exact = F.max((F.col("distance") == 0).cast("int")).over(Window.partitionBy(*keys))
        known = known.withColumn("_exact", exact)
        weight = F.when(F.col("_exact") == 1, (F.col("distance") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.col("distance")))
    else:
        weight = F.lit(1.0)
    votes = known.groupBy(*keys, "label").agg(F.sum(weight).alias("w"))
    return votes.groupBy(*keys).agg(
        F.min_by("label", F.struct(-F.col("w"), F.col("label"))).alias("prediction"), (F.max("w") / F.sum("w")).alias("confidence")
    )


def knn_classify(
    train: DataFrame,
    queries: DataFrame,
    label: str,
    n_neighbors: int = 5,
    weights: str = "uniform",
    p: float = 2.0,
    train_id: str = "id",
    query_id: str = "qid",
    vector: str = "x",
) -> DataFrame:
    """Class of every query by its nearest training points: (qid, prediction, confidence)."""
    if weights not in ("uniform", "distance"):
        raise ValueError("weights must be 'uniform' or 'distance'.")
    found = nearest_neighbours(train, queries, n_neighbors, Metric("minkowski", p), train_id, query_id, vector)
    labels = train.select(F.col(train_id).cast("bigint").alias("id"), F.col(label).alias("label"))
    return vote(found, labels, weights)


def accuracy_by_k(
    folds: DataFrame, label: str, most: int, fold: str = "fold", id_col: str = "id", vector: str = "x"
) -> DataFrame:
    """Mean fold accuracy for every k up to ``most``: one search per fold, then a vote per prefix of ranks."""
    held = materialise(folds.select(F.col(id_col).alias("id"), F.col(vector).alias("x"), F.col(label).alias("label"), F.col(fold).alias("fold")), "folds")
    parts = []
    numbers = sorted(r[0] for r in held.select("fold").distinct().collect())
    for f in numbers:
        train, test = held.filter(F.col("fold") != f), held.filter(F.col("fold") == f)
        found = nearest_neighbours(train, test, most, None, "id", "id", "x").select("qid", "id", "rank")
        labels = train.select("id", "label").hint("merge")  # these tables grow with the input, so none is broadcast
        parts.append(materialise(found.join(labels, "id").select("qid", "label", "rank", F.lit(f).alias("fold")), "knn"))
    known = parts[0]
    for part in parts[1:]:
        known = known.unionByName(part)
    # one shuffle by query; the votes of its prefixes and its truth then meet in place
    prefixes = known.repartition("fold", "qid").withColumn("k", F.explode(F.sequence(F.col("rank"), F.lit(most))))
    votes = prefixes.groupBy("fold", "qid", "k", "label").agg(F.count(F.lit(1)).alias("w"))
    said = votes.groupBy("fold", "qid", "k").agg(F.min_by("label", F.struct(-F.col("w"), F.col("label"))).alias("prediction"))
    truth = held.select("fold", F.col("id").alias("qid"), F.col("label").alias("truth")).hint("merge")
    right = said.join(truth, ["fold", "qid"]).groupBy("fold", "k").agg(F.avg((F.col("prediction") == F.col("truth")).cast("double")).alias("accuracy"))
    return right.groupBy("k").agg(F.avg("accuracy").alias("accuracy")).orderBy("k")


def k_distances(points: DataFrame, neighbours: int = 5, id_col: str = "id", vector: str = "x", rows: int | None = None) -> DataFrame:
    """Distance of each point to its k-th neighbour, itself counted, in ascending order."""
    total = rows if rows is not None else points.count()
    if total < 10:
        raise ValueError("A k-distance table needs at least ten rows.")
    k = min(neighbours, max(2, total - 1))
    found = nearest_neighbours(points, points, k, None, id_col, id_col, vector)
    return found.filter(F.col("rank") == k).select(F.col("qid").alias("id"), F.col("distance").alias("k_distance")).orderBy("k_distance", "id")
