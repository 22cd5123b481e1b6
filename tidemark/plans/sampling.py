"""Seeded exact-size selections that need no shuffle of the rows themselves."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.roles import c, field_type

_STEP = 3  # hexadecimal digits added per pass: 4,096 buckets
_SMALL = 4_096  # candidates of one class that are ranked directly


def hash_key(row_id: str | Column, seed: int) -> Column:
    """Pseudo-random, unique, engine-independent sort key of a row."""
    text = (c(row_id) if isinstance(row_id, str) else row_id).cast("string")
    return F.concat(F.md5(F.concat(F.lit(f"{seed}:"), text)), F.lit(":"), text)


def class_counts(df: DataFrame, label: str) -> dict[Any, int]:
    """Rows per known class. The number of classes is checked before it reaches the driver."""
    limit = 10_000
    rows = (
        df.filter(c(label).isNotNull()).groupBy(c(label).alias("k")).agg(F.count(F.lit(1)).alias("n")).limit(limit + 1).collect()
    )
    if len(rows) > limit:
        raise ValueError(f"Label column '{label}' has more than {limit} distinct values.")
    return {r["k"]: r["n"] for r in sorted(rows, key=lambda r: str(r["k"]))}


def hash_cuts(
    df: DataFrame, row_id: str, seed: int, wanted: Mapping[Any, Sequence[int]], label: str | None = None
) -> dict[Any, list[str]]:
    """For each class and each m, the hash key of its m-th row in hash order.

    Each pass counts rows per key prefix and keeps only the bucket that holds
    the m-th row, so a pass is one scan with a small aggregate, and the last
    ranking sees at most a few thousand candidates per cut.
    """
    spark = df.sparkSession
    class_type = field_type(df, label) if label else T.IntegerType()
    keyed = df.select((c(label) if label else F.lit(0)).alias("_k"), hash_key(row_id, seed).alias("_h"))
    schema = T.StructType(
        [
            T.StructField("_k", class_type),
            T.StructField("_cut", T.IntegerType()),
            T.StructField("_prefix", T.StringType()),
            T.StructField("_left", T.LongType()),
        ]
    )
    open_cuts = [(k, i, "", int(m)) for k, ms in wanted.items() for i, m in enumerate(ms) if m > 0]
    keys: dict[tuple[Any, int], str] = {}
    depth = 0
    sizes = class_counts(df, label) if label else {0: df.count()}
    small = all(n <= _SMALL for n in sizes.values())
    while open_cuts:
        cuts = F.broadcast(spark.createDataFrame(open_cuts, schema))
        near = keyed.join(cuts, (keyed["_k"] == cuts["_k"]) & F.col("_h").startswith(F.col("_prefix"))).select(
            cuts["_k"].alias("_k"), "_cut", "_left", "_h"
        )
        by_cut = Window.partitionBy("_k", "_cut")
        if small:
            ranked = near.withColumn("_r", F.row_number().over(by_cut.orderBy("_h")))
            for r in ranked.filter(F.col("_r") == F.col("_left")).collect():
                keys[(r["_k"], r["_cut"])] = r["_h"]
            break
        depth += _STEP
        buckets = near.groupBy("_k", "_cut", "_left", F.substring("_h", 1, depth).alias("_prefix")).agg(
            F.count(F.lit(1)).alias("_n")
        )
        upto = F.sum("_n").over(by_cut.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, 0))
        crossing = (
            buckets.withColumn("_upto", upto)
            .filter((F.col("_upto") >= F.col("_left")) & (F.col("_upto") - F.col("_n") < F.col("_left")))
            .collect()
        )
        open_cuts = [(r["_k"], r["_cut"], r["_prefix"], r["_left"] - (r["_upto"] - r["_n"])) for r in crossing]
        small = all(r["_n"] <= _SMALL for r in crossing)
    return {k: [keys.get((k, i), "") for i in range(len(ms))] for k, ms in wanted.items()}


def hash_rank_group(
    df: DataFrame, row_id: str, seed: int, wanted: Mapping[Any, Sequence[int]], label: str | None = None, name: str = "_group"
) -> DataFrame:
    """Number of each class's cuts that lie below a row: 0 for its first m rows, and so on."""
    spark = df.sparkSession
    cuts = hash_cuts(df, row_id, seed, wanted, label)
    class_type = field_type(df, label) if label else T.IntegerType()
    schema = T.StructType(
        [T.StructField("_ck", class_type), T.StructField("_cuts", T.ArrayType(T.StringType()))]
    )
    table = F.broadcast(spark.createDataFrame(list(cuts.items()), schema))  # one row per class
    side = c(label) if label else F.lit(0)
    joined = df.join(table, side == F.col("_ck"), "left")
    key = hash_key(row_id, seed)
    passed = F.size(F.filter("_cuts", lambda cut: cut < key))
    return joined.withColumn(name, F.when(F.col("_cuts").isNotNull(), passed)).drop("_ck", "_cuts")
