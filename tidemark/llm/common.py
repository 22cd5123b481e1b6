"""What the operators of this folder share: the registry, scratch tables and Arrow helpers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.session import apply_defaults, remove_folder, scratch_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ARROW_ROWS = 512  # whole texts per Arrow batch: keeps the memory of a Python worker small


def prepare(spark: SparkSession) -> SparkSession:
    """Session options these operators are planned for."""
    apply_defaults(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` is its counterpart."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Parquet tables in the shared folder that cut lineage and survive lost executors.

    ``keep`` writes a table and reads it back; ``drop`` removes tables that
    nothing reads any more. What the returned DataFrame reads stays until the
    driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        self.count = 0

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{name}-{self.count}"
        df.write.parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            remove_folder(self.spark, self.paths[name])


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 bytes of a text column; a null text is empty."""
    return [b"" if t is None else t for t in batch.column(name).cast(pa.binary()).to_pylist()]


def in_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def row_key(*names: str):
    """Hash of a row's identity, null-safe: equal rows share it."""
    return F.xxhash64(*[F.col(n) for n in names], *[F.col(n).isNull() for n in names])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, also where ``body`` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)
