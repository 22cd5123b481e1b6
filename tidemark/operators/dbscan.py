"""Density-based clustering, exact, without listing pairs of points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.graph import connected_components
from tidemark.plans.metric import Metric, block_join, build_cells, empty, matrix, places, tiles, visits
from tidemark.plans.ordered import with_row_id
from tidemark.plans.session import materialise

FINE = 4  # core points are grouped by cells this much smaller than eps allows
MICRO_DIMENSIONS = 16  # beyond this a grid cell hardly ever holds two points
METRICS = ("euclidean", "manhattan", "chebyshev", "minkowski", "cosine", "l1", "l2")


def _micro_width(eps: float, d: int, metric: str) -> float | None:
    """Grid width at which two points of one grid cell are surely within ``eps``."""
    if d > MICRO_DIMENSIONS or metric == "cosine":
        return None
    spread = {"manhattan": float(d), "l1": float(d), "chebyshev": 1.0}.get(metric, float(np.sqrt(d)))
    return eps / spread * (1 - 1e-9)


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots (smallest member) of a forest after the edges between nodes a and b are added."""
    while True:
        a, b = root[a], root[b]
        apart = a != b
        if not apart.any():
            return root
        code = np.unique(np.minimum(a, b)[apart] * len(root) + np.maximum(a, b)[apart])
        a, b = np.divmod(code, len(root))
        np.minimum.at(root, b, a)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up


def _link(points: DataFrame, measure: Metric, eps: float) -> DataFrame:
    """Spanning edges (u, v) between the nodes of points (id, x, node) within ``eps``."""
    cells = build_cells(points.select("id", "x", "node"), measure)
    asks = cells.points.select(F.col("id").alias("qid"), "x", F.col("node").alias("qnode"), F.col("cell").alias("home"))

    def link(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return empty(["u", "v"])
        x, node, y, qnode = matrix(p["x"]), p["node"].to_numpy(), matrix(q["x"]), q["qnode"].to_numpy()
        nodes, at = np.unique(np.concatenate([qnode, node]), return_inverse=True)
        asked, there, root = at[: len(qnode)], at[len(qnode) :], np.arange(len(nodes))
        for s, t in tiles(len(y), len(x)):
            i, j = places(measure.within(y[s], x[t], eps))
            root = _join(root, asked[s][i], there[t][j])
        moved = root != np.arange(len(nodes))
        return pd.DataFrame({"u": nodes[moved], "v": nodes[root[moved]]})

    routed = visits(asks, cells, measure, eps, own="upper", home="home")
    return materialise(block_join(cells, routed, link, "u long, v long"), "links")


def _close_groups(points: DataFrame, measure: Metric, reach: float) -> DataFrame:
    """Nodes whose point lies within ``reach`` of a point of another component (id, x, node, part)."""
    cells = build_cells(points.select("id", "x", "node", "part"), measure)
    asks = cells.points.select(F.col("id").alias("qid"), "x", F.col("node").alias("qnode"), F.col("part").alias("qpart"))

    def near(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return empty(["node"])
        x, part, y, qpart = matrix(p["x"]), p["part"].to_numpy(), matrix(q["x"]), q["qpart"].to_numpy()
        hit = np.zeros(len(y), dtype=bool)
        for s, t in tiles(len(y), len(x)):
            hit[s] |= (measure.within(y[s], x[t], reach) & (qpart[s][:, None] != part[t][None, :])).any(1)
        return pd.DataFrame({"node": q["qnode"].to_numpy()[hit]})

    return materialise(block_join(cells, visits(asks, cells, measure, reach), near, "node long"), "close").distinct()


def dbscan(
    points: DataFrame,
    eps: float = 0.5,
    min_samples: int = 5,
    metric: str = "euclidean",
    id_col: str = "id",
    vector: str = "x",
) -> DataFrame:
    """Cluster of every row: (id, cluster, core); noise is -1, a neighbourhood includes the point itself.

    Identical rows are one weighted point. Points sharing a small enough grid
    cell are mutual neighbours, so a crowded cell is one core group without any
    comparison. Elsewhere blocks count neighbours per point, and blocks of core
    points emit a spanning forest. Clusters are numbered by their smallest core
    row; a border row joins the lowest-numbered cluster it touches.
    """
    if eps <= 0:
        raise ValueError("eps must be greater than 0.")
    if min_samples < 1:
        raise ValueError("min_samples must be at least 1.")
    if metric not in METRICS:
        raise ValueError(f"Unsupported metric: {metric}")
    measure = Metric(metric)
    rows = points.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    unique = rows.groupBy("x").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w"))
    width = _micro_width(float(eps), len(rows.select("x").first()["x"]), metric)
    if width is None:
        unique = unique.withColumns({"dense": F.lit(False), "node": F.col("id")})
    else:
        grid = unique.withColumn("g", F.transform("x", lambda v: F.floor(v / width)))
        crowded = grid.groupBy("g").agg(F.sum("w").alias("gw"), F.min("id").alias("group")).filter(F.col("gw") >= min_samples)
        grid = grid.join(crowded, "g", "left").drop("g", "gw")
        unique = grid.withColumns({"dense": F.col("group").isNotNull(), "node": F.coalesce("group", "id")}).drop("group")
    unique = materialise(unique.select("id", "x", "w", "dense", "node"), "points")
    total = unique.count()

    # cores: how much weight lies within eps of the points no crowded cell vouches for
    every = build_cells(unique, measure, rows=total)
    open_points = unique.filter("NOT dense").select(F.col("id").alias("qid"), "x")

    def count_near(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return empty(["qid", "n"])
        x, w, y = matrix(p["x"]), p["w"].to_numpy(), matrix(q["x"])
        n = np.zeros(len(y), dtype="int64")
        for s, t in tiles(len(y), len(x)):
            i, j = places(measure.within(y[s], x[t], eps))
            n[s] += np.bincount(i, w[t][j], s.stop - s.start).astype("int64")
        return pd.DataFrame({"qid": q["qid"].to_numpy(), "n": n})

    near = block_join(every, visits(open_points, every, measure, float(eps)), count_near, "qid long, n long")
    degree = near.groupBy("qid").agg(F.sum("n").alias("n"))
    marked = unique.join(degree, F.col("id") == F.col("qid"), "left")
    marked = marked.withColumn("core", F.col("dense") | (F.coalesce("n", F.lit(0)) >= min_samples)).drop("qid", "n")
    marked = materialise(marked, "marked")
    cores = marked.filter("core")
    if cores.isEmpty():
        return rows.select("id", F.lit(-1).cast("bigint").alias("cluster"), F.lit(False).alias("core"))
    if width is not None:
        # core points of one small grid cell are neighbours, so they are one group from the start
        small = cores.withColumn("g", F.transform("x", lambda v: F.floor(v / (width / FINE))))
        groups_of = small.groupBy("g").agg(F.min("id").alias("group"))
        cores = small.join(groups_of, "g").select("id", "x", F.col("group").alias("node"))
    cores = materialise(cores.select("id", "x", "node"), "cores")

    # clusters: spanning edges between one point per group, then between the points of
    # those groups that lie close to a group of another component
    edges = _link(cores.filter("id = node"), measure, float(eps))
    if width is not None:
        parts = connected_components(edges)
        named = cores.join(parts.select(F.col("node").alias("_n"), F.col("component").alias("_c")), F.col("node") == F.col("_n"), "left")
        named = materialise(named.select("id", "x", "node", F.coalesce("_c", "node").alias("part")), "parted")
        close = float(eps) * (1 + 2.0 / FINE)
        near_other = _close_groups(named.filter("id = node"), measure, close)
        edge_points = named.join(near_other, "node", "left_semi").select("id", "x", F.col("part").alias("node"))
        inside = named.filter("part <> node").select(F.col("node").alias("u"), F.col("part").alias("v")).distinct()
        edges = inside.unionByName(_link(edge_points, measure, float(eps)))
    parts = connected_components(edges.distinct())
    groups = cores.join(parts.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
    groups = groups.select("id", "x", F.coalesce("component", "node").alias("component"))
    # a group's name is its smallest core row, so its rank is the cluster number
    named = groups.groupBy("component").agg(F.min("id").alias("first"))
    numbered = with_row_id(named, ["first"], (), "cluster").select("component", "cluster")
    labelled = materialise(groups.join(numbered, "component").select("id", "x", "cluster"), "cores")

    # borders: the lowest cluster with a core within eps
    label_cells = build_cells(labelled, measure)
    loose = marked.filter("NOT core").select(F.col("id").alias("qid"), "x")

    def lowest(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return empty(["qid", "cluster"])
        x, k, y = matrix(p["x"]), p["cluster"].to_numpy().astype(float), matrix(q["x"])
        best = np.full(len(y), np.inf)
        for s, t in tiles(len(y), len(x)):
            i, j = places(measure.within(y[s], x[t], eps))
            np.minimum.at(best, i + s.start, k[t][j])
        hit = np.isfinite(best)
        return pd.DataFrame({"qid": q["qid"].to_numpy()[hit], "cluster": best[hit].astype("int64")})

    border = block_join(label_cells, visits(loose, label_cells, measure, float(eps)), lowest, "qid long, cluster long")
    border = border.groupBy("qid").agg(F.min("cluster").alias("cluster")).select(F.col("qid").alias("id"), "cluster", F.lit(False).alias("core"))
    known = labelled.select("id", "cluster", F.lit(True).alias("core")).unionByName(border)
    per_point = marked.select("x", F.col("id").alias("rep")).join(known.withColumnRenamed("id", "rep"), "rep", "left")
    # copies of a point share its cluster
    return rows.join(per_point.drop("rep"), "x", "left").select(
        "id", F.coalesce("cluster", F.lit(-1)).cast("bigint").alias("cluster"), F.coalesce("core", F.lit(False)).alias("core")
    )
