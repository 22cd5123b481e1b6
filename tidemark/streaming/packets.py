"""Text packets to samples. Works alike on streams and tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import coerce_value, coerced_kind

# Fixed value: longest packet in bytes.
MAX_PACKET_BYTES = 65_507


def read_packets(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Stream of packets from text files, one per line, with arrival order columns."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def parse_packets(packets: DataFrame, value: str = "value") -> DataFrame:
    """Add ``samples`` (array of field maps), ``kinds`` (type of each field) and ``error``.

    A packet is a JSON object, an array of JSON objects, or key=value pairs
    separated by ; or ,. Anything else is invalid: ``samples`` is NULL and
    ``error`` says why. Field values stay text until a schema is applied.
    """
    # each stage is a projection of its own, so that a packet is parsed once
    text = F.regexp_replace(F.col(value).cast("string"), r"^\s+|\s+$", "")
    stage = packets.withColumn("_text", F.coalesce(text, F.lit("")))
    # only what can start a JSON value is tried as JSON: a failed parse is costly
    maybe = F.col("_text").rlike(r'^([\[{"0-9-]|(true|false|null)$)')
    stage = stage.withColumn("_json", F.when(maybe, F.try_parse_json("_text")))
    stage = stage.withColumn("_shape", F.schema_of_variant("_json"))
    kind = (
        F.when(F.col("_json").isNull(), "none").when(F.startswith("_shape", F.lit("OBJECT")), "object")
        .when(F.startswith("_shape", F.lit("ARRAY")), "array").otherwise("other")
    )
    one = F.when(kind == "object", F.array("_json")).when(kind == "array", F.try_variant_get("_json", "$", "array<variant>"))
    tokens = F.filter(F.transform(F.split(F.replace("_text", F.lit(";"), F.lit(",")), ","), lambda t: F.trim(t)), lambda t: t != "")
    pairs = F.transform(
        F.when(kind == "none", tokens),
        lambda t: F.struct(
            F.trim(F.substring_index(t, "=", 1)).alias("key"), F.trim(F.substring(t, F.locate("=", t) + 1, F.length(t))).alias("value"),
            F.contains(t, F.lit("=")).alias("split"),
        ),
    )
    stage = stage.withColumns({"_kind": kind, "_items": one, "_pairs": pairs})
    all_objects = F.forall("_items", lambda v: F.schema_of_variant(v).startswith("OBJECT"))
    shape_error = "packet must be a JSON object, a list of JSON objects, or key=value pairs"
    error = (
        F.when(F.col("_text") == "", "empty packet")
        .when(F.col("_kind") == "other", shape_error)
        .when((F.col("_kind") == "array") & ~all_objects, shape_error)
        .when(F.col("_kind") != "none", F.lit(None))
        .when(F.exists("_pairs", lambda p: ~p["split"]), "custom packets must use key=value pairs separated by semicolons")
        .when(F.exists("_pairs", lambda p: p["key"] == ""), "packet contains an empty field name")
        .when(F.size("_pairs") == 0, "no fields found in packet")
    )
    # a repeated key keeps its last value
    names = F.transform("_pairs", lambda p: p["key"])
    last = F.filter("_pairs", lambda e, i: ~F.exists(F.slice("_pairs", i + 2, F.size("_pairs")), lambda p: p["key"] == e["key"]))
    once = F.when(F.size(F.array_distinct(names)) == F.size(names), F.col("_pairs")).otherwise(last)
    raw = F.map_from_entries(F.transform(once, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))
    plain = F.transform_values(
        "_raw",
        lambda _, v: F.when(F.lower(v).isin("true", "false"), F.lower(v)).when(~F.lower(v).isin("null", "none"), v),
    )
    stage = stage.withColumn("error", error)
    ok = F.col("error").isNull()
    objects = F.transform("_items", lambda v: F.try_variant_get(v, "$", "map<string,variant>"))
    stage = stage.withColumns({"_objects": F.when(ok, objects), "_raw": F.when(ok, raw)})
    stage = stage.withColumn("_plain", plain)
    samples = F.coalesce(
        F.transform("_objects", lambda m: F.transform_values(m, lambda _, x: F.try_variant_get(x, "$", "string"))), F.when(F.col("_plain").isNotNull(), F.array("_plain"))
    )
    kinds = F.coalesce(
        F.transform("_objects", lambda m: F.transform_values(m, lambda _, x: _variant_kind(x))),
        F.when(F.col("_raw").isNotNull(), F.array(F.transform_values("_raw", lambda _, v: coerced_kind(v)))),
    )
    return stage.withColumns({"samples": F.when(ok, samples), "kinds": F.when(ok, kinds)}).select(*packets.columns, "error", "samples", "kinds")


def _variant_kind(x: Column) -> Column:
    name = F.schema_of_variant(x)
    return (
        F.when(x.isNull() | (name == "VOID"), "null").when(name == "BOOLEAN", "boolean").when(name == "BIGINT", "long")
        .when(name.startswith("DECIMAL") | name.isin("DOUBLE", "FLOAT"), "double").otherwise("string")
    )


def valid_samples(parsed: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per sample with its field map and its position in the packet.

    The outer explode comes before the filter: a filter on the parsed columns
    would be pushed down to the scan and parse every packet a second time.
    """
    return parsed.select(*keep, F.posexplode_outer("samples").alias("position", "fields")).filter("position IS NOT NULL")


def dead_letters(parsed: DataFrame, value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Invalid packets with the reason."""
    reason = F.explode_outer(F.when(F.col("error").isNotNull(), F.array("error")))
    return parsed.select(*keep, value, reason.alias("error")).filter("error IS NOT NULL")


def packet_counts(parsed: DataFrame) -> DataFrame:
    """Samples received and packets refused."""
    return parsed.agg(
        F.coalesce(F.sum(F.when(F.col("error").isNull(), F.size("samples")).otherwise(0)), F.lit(0)).cast("bigint").alias("received"),
        F.count_if(F.col("error").isNotNull()).alias("invalid"),
    )


def observed(parsed: DataFrame, name: str = "packets") -> DataFrame:
    """The same counters as metrics of each micro-batch of a stream."""
    return parsed.observe(
        name,
        F.sum(F.when(F.col("error").isNull(), F.size("samples")).otherwise(0)).alias("received"),
        F.count_if(F.col("error").isNotNull()).alias("invalid"),
    )


def project_fields(samples: DataFrame, schema: Mapping[str, str], keep: Sequence[str] = (), fields: str = "fields") -> DataFrame:
    """Declared columns of the field map; a field a sample lacks is NULL."""
    cells = []
    for n, t in schema.items():
        raw = F.try_element_at(F.col(fields), F.lit(n))
        # missing values are NULL already; a JSON text "null" stays a text
        cells.append((raw if t.lower() == "string" else coerce_value(raw, t)).alias(n))
    return samples.select(*keep, *cells)


def field_drift(samples: DataFrame, schema: Mapping[str, str], fields: str = "fields") -> DataFrame:
    """Fields that arrive but are not declared, with how often they do."""
    names = samples.select(F.explode(F.map_keys(fields)).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("samples"))
    return names.filter(~F.col("field").isin(list(schema)))
