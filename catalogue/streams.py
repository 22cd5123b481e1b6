"""Packets made from the event table, parsed, buffered, scored and windowed."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalogue.common import query, rnd, rounded, table
from catalogue.signals import features_sql
from tidemark.operators.models import fit_classifier
from tidemark.operators.score import score_table
from tidemark.plans.session import scratch_folder
from tidemark.streaming.buffer import StreamBuffer, start_stream
from tidemark.streaming.packets import (
    dead_letters,
    field_drift,
    packet_counts,
    parse_packets,
    project_fields,
    read_packets,
    valid_samples,
)
from tidemark.streaming.scoring import score_stream
from tidemark.streaming.windows import WindowStream

FIELDS = {"event_id": "bigint", "user_id": "bigint", "ts": "bigint", "x": "double", "y": "double", "kind": "string"}


def _packets(spark, sf_dir):
    """Events as text packets: objects, arrays, key=value pairs and broken ones, by kind of event."""
    ev = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    x = F.when(F.col("event_type") != "error", F.round(F.col("value") - 35.0, 2))
    sample = F.struct("event_id", "user_id", F.col("us").alias("ts"), x.alias("x"), F.col("value").alias("y"), F.col("event_type").alias("kind"))
    as_json = F.to_json(sample)
    pairs = F.concat_ws(
        "; ", F.concat(F.lit("event_id="), "event_id"), F.concat(F.lit("user_id = "), "user_id"), F.concat(F.lit("ts="), "us"),
        F.concat(F.lit("x="), F.coalesce(x.cast("string"), F.lit("null"))), F.concat(F.lit("y="), F.col("value").cast("string")),
        F.concat(F.lit("kind="), "event_type"), F.lit("extra=true"))
    packet = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("["), as_json, F.lit("]"))).when(F.col("event_type").isin("view", "error"), pairs)
        .when((F.col("event_type") == "signup") & (F.col("value") > 100), F.lit("signup without fields")).otherwise(as_json))
    return ev.select("event_id", packet.alias("value"))


_BROKEN = "(event_type = 'signup' AND value > 100)"


@query("packet_samples", f"""
SELECT event_id, user_id, epoch_us(ts)::BIGINT AS ts, CASE WHEN event_type <> 'error' THEN round(value - 35.0::DOUBLE, 2) + 0.0::DOUBLE END AS x, value AS y, event_type AS kind
FROM events WHERE NOT {_BROKEN}""")
def packet_samples(spark, sf_dir):
    """JSON objects, arrays and key=value packets parsed into declared columns (Q2, Q5, O2)."""
    parsed = parse_packets(_packets(spark, sf_dir))
    return rounded(project_fields(valid_samples(parsed), FIELDS), ["x"], 2)


@query("packet_counts", f"SELECT count(*) FILTER (NOT {_BROKEN})::BIGINT AS received, count(*) FILTER ({_BROKEN})::BIGINT AS invalid FROM events")
def packet_counts_query(spark, sf_dir):
    """Samples received and packets refused (Q3)."""
    return packet_counts(parse_packets(_packets(spark, sf_dir)))


@query("packet_dead_letters", f"SELECT event_id, 'signup without fields' AS value, 'custom packets must use key=value pairs separated by semicolons' AS error FROM events WHERE {_BROKEN}")
def packet_dead_letters(spark, sf_dir):
    """Invalid packets with the reason (Q2)."""
    return dead_letters(parse_packets(_packets(spark, sf_dir)), keep=["event_id"])


@query("packet_field_drift", "SELECT 'extra' AS field, count(*)::BIGINT AS samples FROM events WHERE event_type IN ('view', 'error')")
def packet_field_drift(spark, sf_dir):
    """Fields that arrive undeclared (Q5)."""
    return field_drift(valid_samples(parse_packets(_packets(spark, sf_dir))), FIELDS)


def _stream(spark, sf_dir, name):
    """A file stream of the packets and a fresh folder for its state."""
    folder = f"{scratch_folder(spark)}/stream-{name}-{uuid.uuid4().hex}"
    _packets(spark, sf_dir).select("value").repartition(4).write.text(f"{folder}/in")
    samples = project_fields(valid_samples(parse_packets(read_packets(spark, f"{folder}/in", 2))), FIELDS)
    return samples, folder


@query("stream_buffer", f"""
WITH s AS (SELECT event_id, event_type, CASE WHEN event_type <> 'error' THEN round(value - 35.0::DOUBLE, 2) + 0.0::DOUBLE END AS x FROM events WHERE NOT {_BROKEN})
SELECT count(*)::BIGINT AS n_rows, count(DISTINCT event_id)::BIGINT AS n_ids, (count(*) - 1)::BIGINT AS last_seq, count(x)::BIGINT AS known,
  round(sum(x), 2) + 0.0::DOUBLE AS total FROM s""")
def stream_buffer(spark, sf_dir):
    """Streamed samples kept in arrival order under permanent numbers."""
    samples, folder = _stream(spark, sf_dir, "buffer")
    buffer = StreamBuffer(spark, f"{folder}/rows", 10_000_000)
    start_stream(samples, buffer.sink(["ts", "event_id"]), f"{folder}/checkpoint").awaitTermination()
    return buffer.read().agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("event_id").alias("n_ids"), F.max("seq").alias("last_seq"), F.count("x").alias("known"),
        rnd(F.sum("x"), 2).alias("total"))


_WINDOW_SQL = features_sql(20, 10, False, "xy")


@query("stream_windows", f"""WITH w AS ({_WINDOW_SQL}) SELECT count(*)::BIGINT AS windows, count(DISTINCT user_id)::BIGINT AS users, count(DISTINCT (user_id, window_number))::BIGINT AS numbers FROM w""")
def stream_windows(spark, sf_dir):
    """Complete windows of every user, however the samples were cut into batches (Q8)."""
    folder = f"{scratch_folder(spark)}/stream-windows-{uuid.uuid4().hex}"
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("value").alias("y"))
    ev.repartitionByRange(4, "ts", "event_id").write.parquet(f"{folder}/in")
    samples = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    stream = WindowStream(spark, f"{folder}/state", "user_id", ["y"], ["mean", "zcr", "max"], 20, ["ts", "event_id"], overlap_pct=50)
    start_stream(samples, stream.sink(), f"{folder}/checkpoint").awaitTermination()
    return stream.windows().agg(
        F.count(F.lit(1)).alias("windows"), F.count_distinct("user_id").alias("users"), F.count_distinct("user_id", "window_number").alias("numbers"))


# every kind of event as a number, so that the label below follows from it exactly
def _code(kind):
    return F.when(kind == "click", 0).when(kind == "error", 1).when(kind == "purchase", 2).when(kind == "signup", 3).otherwise(4)


_CODE = "CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END"


def _model(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", _code(F.col("event_type")).alias("code"), F.when(_code(F.col("event_type")) >= 2, "high").otherwise("low").alias("level"))
    return fit_classifier(ev, "level", "event_id", "decision_tree", {"max_depth": 3}, ["code"])


@query("stream_scoring", f"""
SELECT event_id, CASE WHEN {_CODE} >= 2 THEN 'high' ELSE 'low' END AS predicted_label, 1.0::DOUBLE AS confidence FROM events WHERE NOT {_BROKEN}""")
def stream_scoring(spark, sf_dir):
    """Live samples scored by a fitted model."""
    model = _model(spark, sf_dir)
    samples, folder = _stream(spark, sf_dir, "score")
    scored = score_stream(samples.select("event_id", _code(F.col("kind")).alias("code")), model)

    def write(rows, batch):
        rows.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    start_stream(scored, write, f"{folder}/checkpoint").awaitTermination()
    return rounded(spark.read.parquet(f"{folder}/out").select("event_id", "predicted_label", "confidence"), ["confidence"], 4)


@query("score_table", f"""
SELECT event_id, CASE WHEN {_CODE} >= 2 THEN 'high' ELSE 'low' END AS predicted_label, 1.0::DOUBLE AS confidence FROM events""")
def score_table_query(spark, sf_dir):
    """A whole table scored with confidence."""
    ev = table(spark, sf_dir, "events").select("event_id", _code(F.col("event_type")).alias("code"))
    out = score_table(ev, _model(spark, sf_dir), "event_id")
    return rounded(out.select("event_id", F.col("Predicted_Label").alias("predicted_label"), F.col("Prediction_Confidence").alias("confidence")), ["confidence"], 4)
