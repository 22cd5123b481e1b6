"""Registry of queries and the table loaders they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.session import apply_defaults
from tidemark.sources.tables import read_parquet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` is its counterpart."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_defaults(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def rnd(x: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; adding zero turns minus zero into zero."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x.cast("double"), digits) + F.lit(0.0)


def rounded(df: DataFrame, names: dict[str, str] | list[str], digits: int = 6) -> DataFrame:
    """Round the given columns (and rename them when a mapping is given)."""
    pairs = names if isinstance(names, dict) else {n: n for n in names}
    cells = []
    for n in df.columns:
        cells.append(rnd(F.col(f"`{n}`"), digits).alias(pairs[n]) if n in pairs else F.col(f"`{n}`"))
    return df.select(*cells)


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values as a signal per user: centred, and missing where the event is an error."""
    ev = table(spark, sf_dir, "events")
    x = F.when(F.col("event_type") != "error", F.col("value") - 35.0)
    return ev.select("event_id", "ts", "user_id", "event_type", x.alias("x"), F.col("value").alias("y"))


SIGNAL_SQL = """
sig AS (
  SELECT event_id, ts, user_id, event_type,
         CASE WHEN event_type <> 'error' THEN value - 35.0::DOUBLE END AS x, value AS y
  FROM events)
"""
