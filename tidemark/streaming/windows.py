"""Count windows per key over a stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.windows import window_layout, windowed_features
from tidemark.plans.ordered import with_row_id
from tidemark.plans.roles import c


class WindowStream:
    """Features of every complete window of each key, as its samples arrive.

    The state lies in two tables per micro-batch: how many samples each key has
    had, and the samples that later windows still need (less than one window
    per key). A batch joins them and runs the same windowed aggregation as a
    table does, so a key that sends a third of a batch is split like any other.
    A replayed batch rewrites its own tables; windows appear exactly once.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        key: str,
        columns: Sequence[str],
        keys: Sequence[str],
        window_size: float,
        order_by: Sequence[str],
        unit: str = "samples",
        overlap_pct: float = 0,
        window_type: str = "Sliding Windows",
        sample_rate_hz: float = 1.0,
    ):
        self.spark, self.path, self.key = spark, path, key
        self.columns, self.keys, self.order_by = list(columns), list(keys), list(order_by)
        self.size, self.unit, self.overlap, self.kind, self.rate = window_size, unit, overlap_pct, window_type, sample_rate_hz
        self.layout = window_layout(window_size, unit, overlap_pct, window_type, False, sample_rate_hz)

    def _read(self, what: str, batch: int) -> DataFrame | None:
        """State after the newest batch before ``batch``."""
        try:
            table = self.spark.read.parquet(f"{self.path}/{what}")
        except Exception as error:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
                return None
            raise
        last = table.filter(F.col("batch") < batch).agg(F.max("batch").alias("b")).first()["b"]
        return None if last is None else table.filter(F.col("batch") == last).drop("batch")

    def process(self, rows: DataFrame, batch: int) -> None:
        """Take in one micro-batch, for ``foreachBatch``."""
        if rows.isEmpty():
            return
        narrow = rows.select(c(self.key), *[c(n) for n in dict.fromkeys([*self.order_by, *self.columns])])
        fresh = with_row_id(narrow, self.order_by, [self.key], "_i").select(c(self.key), "_i", *[c(n) for n in self.columns])
        seen, kept = self._read("seen", batch), self._read("kept", batch)
        counts = fresh.groupBy(c(self.key)).agg(F.count(F.lit(1)).alias("_new"))
        if seen is not None:
            fresh = fresh.join(seen, self.key, "left").withColumn("_i", F.col("_i") + F.coalesce("_seen", F.lit(0))).drop("_seen")
            counts = counts.join(seen, self.key, "full_outer")
            counts = counts.select(c(self.key), (F.coalesce("_new", F.lit(0)) + F.coalesce("_seen", F.lit(0))).alias("_seen"))
        else:
            counts = counts.withColumnRenamed("_new", "_seen")
        samples = fresh if kept is None else fresh.unionByName(kept)
        made = windowed_features(
            samples, self.columns, self.keys, self.size, partition_by=[self.key], unit=self.unit, overlap_pct=self.overlap,
            window_type=self.kind, sample_rate_hz=self.rate, index="_i", snake_names=True,
        )
        made.write.mode("overwrite").parquet(f"{self.path}/windows/batch={int(batch)}")
        counts.write.mode("overwrite").parquet(f"{self.path}/seen/batch={int(batch)}")
        done = self.spark.read.parquet(f"{self.path}/seen/batch={int(batch)}")
        following = self.layout.full_windows(F.col("_seen")) * self.layout.step
        left = samples.join(done.select(c(self.key), following.alias("_next")), self.key).filter(F.col("_i") >= F.col("_next"))
        left.drop("_next").write.mode("overwrite").parquet(f"{self.path}/kept/batch={int(batch)}")

    def sink(self) -> Callable[[DataFrame, int], None]:
        return self.process

    def windows(self) -> DataFrame:
        """All windows completed so far."""
        return self.spark.read.parquet(f"{self.path}/windows").drop("batch")
