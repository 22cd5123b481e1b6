"""Table readers and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.ordered import with_row_id
from tidemark.plans.roles import c, nan_to_null, require_columns


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    columns: Sequence[str] | None = None,
    schema: T.StructType | str | None = None,
    sampling_ratio: float | None = None,
) -> DataFrame:
    """CSV with a header; a byte-order mark is skipped.

    Chosen columns come in file order. Give ``schema`` for large inputs:
    inferring it costs one more pass (or a share of it, ``sampling_ratio``).
    """
    reader = spark.read.option("header", True).option("encoding", "UTF-8")
    if schema is not None:
        df = reader.schema(schema).csv(path)
    else:
        reader = reader.option("inferSchema", True)
        if sampling_ratio is not None:
            reader = reader.option("samplingRatio", sampling_ratio)
        df = reader.csv(path)
    df = df.withColumnsRenamed({n: n.lstrip("﻿") for n in df.columns if n.startswith("﻿")})
    # small integers widen to one integer type, as the data model has only one
    df = df.select(*[c(f.name).cast("bigint").alias(f.name) if isinstance(f.dataType, T.IntegralType) else c(f.name) for f in df.schema])
    df = nan_to_null(df)
    return select_columns(df, columns) if columns is not None else df


def available_columns(spark: SparkSession, path: str, fmt: str = "csv") -> list[str]:
    """Column names of a file without reading its rows."""
    if fmt == "csv":
        head = spark.read.option("header", True).csv(path)
        return [n.lstrip("﻿") for n in head.columns]
    return spark.read.format(fmt).load(path).columns


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Chosen columns in the order of the table."""
    require_columns(df, columns)
    wanted = set(columns)
    return df.select(*[c(n) for n in df.columns if n in wanted])


def read_parquet(spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet table; only the chosen columns are read. NaN counts as missing."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return nan_to_null(select_columns(df, columns) if columns is not None else df)


def ingest(df: DataFrame, order_by: Sequence[str], path: str, row_id: str = "row_id") -> DataFrame:
    """Give every row its permanent id once and store the table."""
    with_row_id(df, order_by, (), row_id).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def flatten_matrix(df: DataFrame, array_col: str, prefix: str, width: int) -> DataFrame:
    """Array column to scalar columns ``prefix_0 …``; width 1 keeps the bare name."""
    if width < 1:
        raise ValueError("width must be at least 1.")
    cells = [F.get(c(array_col), F.lit(i)).alias(f"{prefix}_{i}" if width > 1 else prefix) for i in range(width)]
    return df.select(*[c(n) for n in df.columns if n != array_col], *cells)


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists", require_rows: str | None = None) -> str:
    """Write as CSV with a header (or parquet). ``require_rows`` is the error for an empty table.

    The output is a folder with one file per partition; Spark's commit
    protocol makes it appear only when it is complete.
    """
    if require_rows is not None and df.isEmpty():
        raise ValueError(require_rows)
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).option("encoding", "UTF-8").csv(path)
    else:
        writer.format(fmt).save(path)
    return path


def write_features(features: DataFrame, path: str, fmt: str = "csv") -> str:
    return write_table(features, path, fmt, require_rows="Run feature extraction before exporting features.")


def write_predictions(predictions: DataFrame, path: str, prediction: str = "Predicted_Label", fmt: str = "csv") -> str:
    if prediction not in predictions.columns:
        raise ValueError("Score the dataset before exporting predictions.")
    return write_table(predictions, path, fmt, require_rows="Score the dataset before exporting predictions.")


def write_corrected(corrected: DataFrame, path: str, fmt: str = "csv") -> str:
    return write_table(corrected, path, fmt, require_rows="No dataset is available for export.")


def write_annotations(log: DataFrame, path: str, fmt: str = "csv") -> str:
    return write_table(log.orderBy("row_index"), path, fmt, require_rows="No annotations are available for export.")


def write_clustered(clustered: DataFrame, path: str, cluster: str = "cluster", fmt: str = "csv") -> str:
    """Clustered rows with ``cluster_description`` (noise or cluster)."""
    return write_table(describe_clusters(clustered, cluster), path, fmt)


def describe_clusters(clustered: DataFrame, cluster: str = "cluster") -> DataFrame:
    return clustered.withColumn("cluster_description", F.when(c(cluster) == -1, "Noise").otherwise("Cluster"))


def write_comparison(comparison: DataFrame, path: str, fmt: str = "csv") -> str:
    """The nine identifying and classification columns of a model comparison."""
    # Columns of an exported comparison.
    names = ["name", "label", "source", "category", "algorithm", "accuracy", "precision", "recall", "f1"]
    return write_table(comparison.select(*names), path, fmt, require_rows="There are no saved model results to export.")
