"""Timing of rows for playback next to recorded media."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import to_seconds
from tidemark.plans.ordered import with_halo
from tidemark.plans.roles import c, field_type, is_numeric

# Shortest and longest delay between two rows, in milliseconds.
SHORTEST_MS, LONGEST_MS = 10, 10_000
# Numeric units per second.
UNITS_PER_SECOND = {"ns": 1e9, "us": 1e6, "ms": 1e3, "s": 1.0}


def playback_interval(
    df: DataFrame,
    row_id: str,
    timestamp_col: str | None,
    fallback_ms: int,
    numeric_unit: str = "ns",
    partition_by: Sequence[str] = (),
    name: str = "interval_ms",
) -> DataFrame:
    """Delay to the next row in ms, within 10 ms and 10 s.

    The last row, unreadable times and steps that do not go forward use the
    fallback. Bare numbers count nanoseconds unless ``numeric_unit`` says otherwise.
    """
    fallback = F.lit(int(fallback_ms)).cast("bigint")
    if not timestamp_col or timestamp_col not in df.columns:
        return df.withColumn(name, fallback)
    if is_numeric(df, timestamp_col):
        at = c(timestamp_col).cast("double") / UNITS_PER_SECOND[numeric_unit]
    else:
        at = to_seconds(c(timestamp_col), timestamp_col, field_type(df, timestamp_col))
    blocks = with_halo(df.withColumn("_t", at), row_id, lookahead=1)
    following = Window.partitionBy(*[c(k) for k in partition_by], "_block").orderBy(c(row_id))
    blocks = blocks.withColumns({"_next": F.lead("_t").over(following), "_has": F.lead(F.lit(True)).over(following)})
    gap = F.round((F.col("_next") - F.col("_t")) * 1e6) / 1e3
    ms = gap.cast("bigint")
    clamped = F.greatest(F.lit(SHORTEST_MS), F.least(F.when(ms > 0, ms).otherwise(fallback), F.lit(LONGEST_MS)))
    value = F.when(F.col("_has").isNull() | gap.isNull(), fallback).otherwise(clamped).cast("bigint")
    return blocks.withColumn(name, value).filter("_own").drop("_block", "_own", "_t", "_next", "_has")


def media_position(
    df: DataFrame,
    row_id: str,
    timestamp_col: str | None,
    fallback_interval_ms: int,
    offset_ms: int = 0,
    name: str = "position_ms",
) -> DataFrame:
    """Media position in ms: time since the first row plus an offset, never negative.

    Without a time column the row number times the interval is used. An
    unreadable time has no position.
    """
    offset = F.lit(int(offset_ms))
    if not timestamp_col or timestamp_col not in df.columns:
        at = c(row_id) * F.lit(int(fallback_interval_ms)) + offset
        return df.withColumn(name, F.greatest(F.lit(0), at).cast("bigint"))
    seconds = to_seconds(c(timestamp_col), timestamp_col, field_type(df, timestamp_col))
    first = df.agg(F.min_by(F.struct(seconds.alias("s")), c(row_id)).alias("o")).select(F.col("o.s").alias("_origin"))
    joined = df.join(F.broadcast(first), F.lit(True), "left")  # one row
    elapsed = F.greatest(F.lit(0.0), seconds - F.col("_origin"))
    at = F.bround(elapsed * 1000.0).cast("bigint") + offset
    known = seconds.isNotNull() & F.col("_origin").isNotNull()
    return joined.withColumn(name, F.when(known, F.greatest(F.lit(0), at)).cast("bigint")).drop("_origin")
