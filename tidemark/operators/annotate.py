"""Human label corrections as an append-only log joined to the data when read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.roles import c, guess_time_column, require_columns

# Columns of the annotation log.
ANNOTATION_COLUMNS = ["row_index", "timestamp", "predicted_label", "corrected_label", "annotation_note"]


def annotation_log(
    df: DataFrame, entries: DataFrame, row_id: str, timestamp_col: str | None = None
) -> DataFrame:
    """Current annotation of every annotated row.

    ``entries`` holds row_index, predicted_label, corrected_label,
    annotation_note and ``seq``; the highest ``seq`` of a row wins. The time
    is the row's own (given or guessed column), else its index. Entries with a
    blank label are refused; ids outside the table are kept out of the log.
    """
    require_columns(entries, ["row_index", "predicted_label", "corrected_label", "annotation_note", "seq"], "Annotation columns")
    label = F.trim("corrected_label")
    if not entries.filter(F.coalesce(label, F.lit("")) == "").limit(1).isEmpty():
        raise ValueError("A corrected label/state is required.")
    latest = entries.groupBy("row_index").agg(
        F.max_by(
            F.struct("predicted_label", label.alias("corrected_label"), F.trim("annotation_note").alias("annotation_note")), "seq"
        ).alias("e")
    )
    time_col = timestamp_col if timestamp_col in df.columns else guess_time_column(df.drop(row_id))
    stamp = c(time_col).cast("string") if time_col else c(row_id).cast("string")
    stamps = df.select(c(row_id).alias("row_index"), stamp.alias("timestamp"))
    return latest.join(stamps, "row_index").select("row_index", "timestamp", "e.*").select(*ANNOTATION_COLUMNS)


def upsert_annotations(log: DataFrame, newer: DataFrame) -> DataFrame:
    """Rows of ``newer`` replace those of ``log`` with the same index."""
    both = log.withColumn("_v", F.lit(0)).unionByName(newer.withColumn("_v", F.lit(1)))
    packed = F.struct(*[c(n) for n in ANNOTATION_COLUMNS[1:]])
    return both.groupBy("row_index").agg(F.max_by(packed, "_v").alias("e")).select("row_index", "e.*")


def corrected_dataset(df: DataFrame, log: DataFrame, row_id: str, name: str = "corrected_label") -> DataFrame:
    """The table with corrected labels laid over it; an existing correction stays otherwise."""
    old: Column = c(name) if name in df.columns else F.lit(None).cast("string")
    fixes = log.select(F.col("row_index").alias("_rid"), F.col("corrected_label").alias("_fix"))
    joined = df.join(fixes, c(row_id) == F.col("_rid"), "left")
    return joined.withColumn(name, F.coalesce("_fix", old)).drop("_rid", "_fix")


def correction_for_row(log: DataFrame, row_index: int) -> DataFrame:
    """Current correction of one row."""
    return log.filter(F.col("row_index") == row_index).select("corrected_label", "annotation_note")
