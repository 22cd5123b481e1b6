"""Session defaults and the reliable folder used to cut long lineages."""

from __future__ import annotations

import atexit
import os
import sys
import tempfile
import uuid
import zipfile

import pyspark
from pyspark.sql import DataFrame, SparkSession

import tidemark

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "20000",
}


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Set the runtime options every operator here is planned for."""
    for key, value in SESSION_DEFAULTS.items():
        spark.conf.set(key, value)
    ship_code(spark)
    return spark


def ship_code(spark: SparkSession) -> None:
    """Send this package to the workers, unless they can import it from where they start."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(tidemark.__file__)))
    own = os.path.dirname(os.path.dirname(os.path.abspath(pyspark.__file__)))
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home in (*known, os.getcwd(), own) or getattr(spark.sparkContext, "_tidemark_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="tidemark-code-"), "tidemark.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(os.path.dirname(os.path.abspath(tidemark.__file__))):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, home))
    spark.sparkContext.addPyFile(path)
    spark.sparkContext._tidemark_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """Folder that outlives executors: the cluster's checkpoint folder.

    The session's own setting wins. Only a local master may fall back to a
    temporary folder, because there every task shares the driver's disk.
    """
    for configured in (
        spark.conf.get("spark.checkpoint.dir", None),
        spark.sparkContext.getConf().get("spark.checkpoint.dir", None),
        spark.sparkContext.getCheckpointDir(),
    ):
        if configured:
            return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder that every executor can reach.")
    folder = tempfile.mkdtemp(prefix="tidemark-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def scratch_folder(spark: SparkSession) -> str:
    """This driver's own folder below the shared one; it goes when the driver ends."""
    base = shared_folder(spark)
    held = getattr(spark.sparkContext, "_tidemark_scratch", None)
    if held is None or not held.startswith(f"{base}/"):
        held = f"{base}/tidemark-{uuid.uuid4().hex}"
        spark.sparkContext._tidemark_scratch = held
        atexit.register(_remove, spark, held)
    return held


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store holds it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        try:
            remove_folder(spark, path)
        except Exception as error:  # noqa: BLE001 - the driver ends anyway
            print(f"could not remove {path}: {error}", file=sys.stderr)


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, fixes anything that
    depends on partition numbers and keeps column pruning for later readers.
    The table lies in this driver's scratch folder and goes when it ends.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
