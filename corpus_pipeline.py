"""A corpus pipeline of five stages, each a filter or rewrite of the documents its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, lines, pieces, quality, simhash
from tidemark.llm.common import Scratch, prepare, row_key, table

LEAST_QUALITY = 0.3


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones among them, does not reject."""
    prepare(spark)
    network = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, network, LEAST_QUALITY)


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; one of which nothing is left goes."""
    prepare(spark)
    found = lines.dedup_lines(docs)
    empty = (F.col("n_dropped") > 0) & ~F.col("text").rlike("[^ \t\r\n]")
    changed = F.when(F.col("n_dropped") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.filter(~empty).withColumn("n_chars", changed).select(docs.columns)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the smallest doc_id, a missing id last."""
    prepare(spark)
    scratch = Scratch(spark, "stay")
    named = docs.withColumn("__row", row_key("doc_id", "text"))
    found = simhash.near_duplicates(named, shingle=4, max_bits=4, id_col="__row").select(F.col("doc_id").alias("__row"), "component_id").distinct()
    # Every row of a component is one of its id and text, so clashing ids do not meet.
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row"))["__row"]
    ids = scratch.keep("ids", named.select("__row", "doc_id").distinct())
    stay = scratch.keep("rows", ids.join(found.hint("merge"), "__row").groupBy("component_id").agg(least.alias("__row")).select("__row"))
    first = Window.partitionBy("__row").orderBy("__row")
    kept = named.join(stay.hint("merge"), "__row", "left_semi").withColumn("__n", F.row_number().over(first)).filter("__n = 1")
    return kept.select(docs.columns)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    prepare(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def _encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their four best segmentations into pieces, and whether the ids spell the text again."""
    prepare(spark)
    both = pieces.decode_texts(pieces.encode_texts(docs))
    return both.withColumn("exact", F.col("decoded") == F.coalesce("text", F.lit(""))).drop("decoded")


STAGES = [
    ("quality", _quality),
    ("line_dedup", _lines),
    ("near_duplicates", _near_duplicates),
    ("decontamination", _decontaminate),
    ("sentencepiece", _encode),
]
ORACLE_SQL = None  # the classifier is no SQL; tests/llm compares the stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage returns is written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = scratch.keep(name, docs)
    return docs
