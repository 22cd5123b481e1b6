"""Connected components of any size by random contraction, without the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v); a component is named by one of its nodes.

    Each round merges a node into the neighbour with the smallest random number,
    its own included; a constant share of the nodes goes each time and edges
    inside merged groups vanish, so no group becomes one row's work. The
    rounds' maps are composed backwards. All tables lie in the shared folder,
    and joins read written tables on both sides, so hot nodes can be split.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    now = scratch.keep("edges", both.filter("u <> v").distinct())
    maps: list[DataFrame] = []
    while now.limit(1).count():
        salt = F.lit(len(maps) + 1)
        best = now.groupBy("u").agg(F.min(F.struct(F.xxhash64(salt, "v").alias("h"), F.col("v").alias("n"))).alias("b"))
        own = F.struct(F.xxhash64(salt, "u").alias("h"), F.col("u").alias("n"))
        step = scratch.keep(f"merge{len(maps)}", best.select(F.col("u").alias("node"), F.least("b", own)["n"].alias("up")))
        maps.append(step)
        left = step.select(F.col("node").alias("u"), F.col("up").alias("nu"))
        right = step.select(F.col("node").alias("v"), F.col("up").alias("nv"))
        moved = now.join(left, "u").join(right, "v").filter("nu <> nv").select(F.col("nu").alias("u"), F.col("nv").alias("v"))
        now = scratch.keep("edges", moved.distinct())
    if not maps:
        return edges.select(F.col("u").alias("node"), F.col("u").alias("component")).limit(0)
    labels = maps[-1].select("node", F.col("up").alias("component"))
    for step in reversed(maps[:-1]):
        upper = labels.select(F.col("node").alias("up"), "component")
        labels = step.join(upper, "up", "left").select("node", F.coalesce("component", "up").alias("component"))
        labels = scratch.keep("labels", labels)
    return labels
