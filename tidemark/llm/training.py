"""Labelled rows a classifier may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept for evaluation: the id's crc32, as text, is divisible by five."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, label_col: str, rows: int, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text, label): at most ``rows`` labelled rows of each class, none of them held out.

    The rows with the smallest hashes of their ids are taken, so the choice
    does not depend on partitions. Rows without an id or a label take no part.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label"))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    parts = [known.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for c in (0, 1)]
    chosen = F.broadcast(parts[0].unionAll(parts[1]))
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.join(chosen, "doc_id").filter("text is not null")
