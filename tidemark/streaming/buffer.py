"""The last N rows of a stream as a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.ordered import with_row_id
from tidemark.plans.session import remove_folder

# Rows a buffer keeps by default, and the fewest it may keep.
DEFAULT_ROWS, FEWEST_ROWS = 100_000, 100


class StreamBuffer:
    """Parts numbered in arrival order; reading keeps the newest rows and writing deletes parts that hold none of them.

    Row numbers never change, so annotations stay attached to their rows; those
    of evicted rows drop out of a semi-join. A batch that is replayed after a
    failure overwrites its own part.
    """

    def __init__(self, spark: SparkSession, path: str, max_rows: int = DEFAULT_ROWS):
        self.spark, self.path = spark, path
        self.max_rows = max(FEWEST_ROWS, int(max_rows))

    def _load(self, what: str) -> DataFrame | None:
        try:
            return self.spark.read.option("mergeSchema", True).parquet(f"{self.path}/{what}")
        except Exception as error:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
                return None
            raise

    def _parts(self) -> DataFrame | None:
        return self._load("rows")

    def append(self, rows: DataFrame, batch: int, order_by: list[str]) -> None:
        """Add a batch: late columns widen the table, earlier rows have NULL there.

        Each batch leaves one counter row, so the next one never scans old rows.
        """
        counters = self._load("counters")
        first = None if counters is None else counters.filter(F.col("batch") < int(batch)).agg(F.max("following").alias("m")).first()["m"]
        first = int(first or 0)
        target = f"{self.path}/rows/batch={int(batch)}"
        with_row_id(rows, order_by, (), "seq").withColumn("seq", F.col("seq") + first).write.mode("overwrite").parquet(target)
        count = self.spark.read.parquet(target).count()
        counter = self.spark.createDataFrame([(first, first + count)], "first long, following long")
        counter.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/counters/batch={int(batch)}")
        self._evict(int(batch))

    def _evict(self, batch: int) -> None:
        """Delete parts whose rows are all older than the newest ``max_rows``; only the current batch can be replayed."""
        counters = self._load("counters")
        newest = int(counters.agg(F.max("following").alias("m")).first()["m"])
        old = counters.filter((F.col("following") <= newest - self.max_rows) & (F.col("batch") < batch)).select("batch").collect()
        for r in old:
            for what in ("rows", "counters"):
                remove_folder(self.spark, f"{self.path}/{what}/batch={r['batch']}")

    def sink(self, order_by: list[str]) -> Callable[[DataFrame, int], None]:
        """Function for ``writeStream.foreachBatch``."""

        def write(rows: DataFrame, batch: int) -> None:
            if not rows.isEmpty():
                self.append(rows, batch, order_by)

        return write

    def read(self) -> DataFrame:
        """The newest ``max_rows`` rows; whole parts that are too old are never opened."""
        parts, counters = self._parts(), self._load("counters")
        if parts is None or counters is None:
            raise ValueError("No streamed rows are available for export.")
        oldest = int(counters.agg(F.max("following").alias("m")).first()["m"]) - self.max_rows
        first_part = counters.filter(F.col("following") > oldest).agg(F.min("batch").alias("b")).first()["b"]
        return parts.filter((F.col("batch") >= first_part) & (F.col("seq") >= oldest))

    def retain(self, annotations: DataFrame) -> DataFrame:
        """Annotations of rows that are still in the buffer."""
        return annotations.join(self.read().select(F.col("seq").alias("row_index")), "row_index", "left_semi")

    def export(self, path: str, fmt: str = "csv") -> str:
        """Write the buffered rows in arrival order."""
        rows = self.read().orderBy("seq").drop("batch", "seq")
        writer = rows.write.mode("errorifexists")
        if fmt == "csv":
            writer.option("header", True).csv(path)
        else:
            writer.format(fmt).save(path)
        return path


def start_stream(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, refresh: str | None = None):
    """Run ``write`` per micro-batch: every ``refresh`` interval, or once over what is there."""
    query = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    query = query.trigger(processingTime=refresh) if refresh else query.trigger(availableNow=True)
    return query.start()


def latest_row(rows: DataFrame, order: str) -> DataFrame:
    """The newest row of a batch."""
    return rows.orderBy(F.desc(order)).limit(1)
