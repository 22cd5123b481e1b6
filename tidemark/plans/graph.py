"""Connected components by random contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.session import materialise

DRIVER_EDGES = 50_000  # a graph this small is finished in memory


def _finish(edges: DataFrame) -> DataFrame:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for u, v in edges.select("u", "v").collect():
        a, b = root(u), root(v)
        if a != b:
            parent[max(a, b)] = min(a, b)
    rows = [(n, root(n)) for n in list(parent)]
    return edges.sparkSession.createDataFrame(rows, "node long, root long")


def connected_components(edges: DataFrame, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """Component of every node that has an edge: (node, component), named by its smallest node.

    Each round merges every node into the closed neighbour with the smallest
    random priority, which shrinks the graph by a constant factor; edges inside
    a merged group vanish, so a big component never becomes a hot key. The
    rounds' maps are composed at the end.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    current = materialise(both.filter("u <> v").distinct(), "edges")
    maps: list[DataFrame] = []
    turn = 0
    while current.count() > driver_edges:
        turn += 1
        chance = lambda x: F.xxhash64(F.lit(turn), x)  # noqa: B023, E731 - used within this round
        best = current.groupBy("u").agg(F.min(F.struct(chance(F.col("v")).alias("h"), F.col("v").alias("n"))).alias("b"))
        own = F.struct(chance(F.col("u")).alias("h"), F.col("u").alias("n"))
        chosen = materialise(best.select(F.col("u").alias("node"), F.least("b", own)["n"].alias("parent")), "merge")
        maps.append(chosen)
        left = chosen.select(F.col("node").alias("u"), F.col("parent").alias("pu"))
        right = chosen.select(F.col("node").alias("v"), F.col("parent").alias("pv"))
        merged = current.join(left, "u").join(right, "v").filter("pu <> pv")
        current = materialise(merged.select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct(), "edges")
    labels = _finish(current)
    for step in reversed(maps):
        upper = labels.select(F.col("node").alias("parent"), "root")
        labels = step.join(upper, "parent", "left").select("node", F.coalesce("root", "parent").alias("root"))
    if maps:
        labels = materialise(labels, "roots")
    smallest = labels.groupBy("root").agg(F.min("node").alias("component"))
    return labels.join(smallest, "root").select("node", "component")
