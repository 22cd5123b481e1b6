"""Every table sink written and read back, and the queries that check a filter by its rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalogue.analysis import _MI_SQL
from catalogue.common import query, rounded, table
from catalogue.streams import _BROKEN, _packets
from tidemark.operators import analysis as an
from tidemark.operators import selftrain as st
from tidemark.operators.annotate import annotation_log, corrected_dataset
from tidemark.operators.cluster import clustering_metrics
from tidemark.operators.evaluate import classification_metrics, comparison_table
from tidemark.operators.profile import drop_noise
from tidemark.plans.session import scratch_folder
from tidemark.sources.tables import read_csv, write_annotations, write_clustered, write_comparison, write_corrected, write_predictions
from tidemark.streaming.buffer import StreamBuffer, start_stream
from tidemark.streaming.packets import parse_packets, project_fields, read_packets, valid_samples


def _path(spark, name):
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("predictions_written", """
SELECT event_id, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS "Predicted_Label", round(value / 1000, 6) + 0.0::DOUBLE AS "Prediction_Confidence" FROM events""")
def predictions_written(spark, sf_dir):
    """Predicted labels with their confidence, written and read back."""
    ev = table(spark, sf_dir, "events")
    said = ev.select("event_id", F.when(F.col("value") > 50, "high").otherwise("low").alias("Predicted_Label"), (F.col("value") / 1000).alias("Prediction_Confidence"))
    return rounded(read_csv(spark, write_predictions(said, _path(spark, "predictions"))), ["Prediction_Confidence"])


def _corrections(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    entries = ev.filter("user_id % 7 = 0").select(
        F.col("event_id").alias("row_index"), F.col("event_type").alias("predicted_label"), F.concat(F.lit("not "), "event_type").alias("corrected_label"),
        F.lit("seen").alias("annotation_note"), F.lit(1).alias("seq"))
    return ev, annotation_log(ev, entries, "event_id", "event_id")


@query("corrected_written", """
SELECT event_id, event_type, user_id::BIGINT AS user_id, CASE WHEN user_id % 7 = 0 THEN 'not ' || event_type END AS corrected_label FROM events""")
def corrected_written(spark, sf_dir):
    """The table with corrections laid over it, written and read back (A10)."""
    ev, log = _corrections(spark, sf_dir)
    return read_csv(spark, write_corrected(corrected_dataset(ev, log, "event_id"), _path(spark, "corrected")))


@query("annotations_written", """
SELECT event_id AS row_index, event_id AS timestamp, event_type AS predicted_label, 'not ' || event_type AS corrected_label, 'seen' AS annotation_note FROM events WHERE user_id % 7 = 0""")
def annotations_written(spark, sf_dir):
    """The annotation log, written and read back (A10)."""
    _, log = _corrections(spark, sf_dir)
    return read_csv(spark, write_annotations(log, _path(spark, "annotations")))


@query("clustered_written", """
SELECT c_custkey::BIGINT AS c_custkey, (c_nationkey % 4 - 1)::BIGINT AS cluster, CASE WHEN c_nationkey % 4 = 0 THEN 'Noise' ELSE 'Cluster' END AS cluster_description FROM customer""")
def clustered_written(spark, sf_dir):
    """Clustered rows with what their cluster is called, written and read back."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") % 4 - 1).alias("cluster"))
    return read_csv(spark, write_clustered(rows, _path(spark, "clustered")))


@query("comparison_written", """
WITH g AS (SELECT count(*) FILTER (l_quantity > 25 AND l_returnflag = 'R')::DOUBLE AS a, count(*) FILTER (l_quantity > 25 AND l_returnflag <> 'R') AS b,
  count(*) FILTER (l_quantity <= 25 AND l_returnflag = 'R') AS c, count(*) FILTER (l_quantity <= 25 AND l_returnflag <> 'R') AS d, count(*) AS n FROM lineitem)
SELECT 'half' AS name, 'returned' AS label, 'project' AS source, 'supervised' AS category, 'rule' AS algorithm, round((a + d) / n, 4) AS accuracy,
  round((a / (a + b) * (a + c) + d / (c + d) * (b + d)) / n, 4) AS precision, round((a + d) / n, 4) AS recall,
  round((2 * a / (2 * a + b + c) * (a + c) + 2 * d / (2 * d + b + c) * (b + d)) / n, 4) AS f1 FROM g""")
def comparison_written(spark, sf_dir):
    """The comparison of models, written and read back."""
    li = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("string").alias("returned"), (F.col("l_quantity") > 25).cast("string").alias("guess"))
    metrics = classification_metrics(li, "returned", "guess").first().asDict()
    compared = comparison_table(spark, [{"name": "half", "label": "returned", "category": "supervised", "algorithm": "rule", "metrics": metrics}])
    return read_csv(spark, write_comparison(compared, _path(spark, "comparison")))


@query("stream_export", f"""
SELECT event_id, event_type AS kind FROM events WHERE NOT {_BROKEN} ORDER BY epoch_us(ts) DESC, event_id DESC LIMIT 300""")
def stream_export(spark, sf_dir):
    """The newest rows of a buffer smaller than its stream, exported."""
    folder = _path(spark, "export")
    _packets(spark, sf_dir).select("value").write.text(f"{folder}/in")
    fields = {"event_id": "bigint", "ts": "bigint", "kind": "string"}
    samples = project_fields(valid_samples(parse_packets(read_packets(spark, f"{folder}/in"))), fields)
    buffer = StreamBuffer(spark, f"{folder}/rows", 300)
    start_stream(samples, buffer.sink(["ts", "event_id"]), f"{folder}/checkpoint").awaitTermination()
    return read_csv(spark, buffer.export(f"{folder}/out"), ["event_id", "kind"])


@query("drop_noise", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'N'")
def drop_noise_query(spark, sf_dir):
    """Rows that belong to a cluster."""
    li = table(spark, sf_dir, "lineitem")
    marked = li.select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "N", -1).otherwise(F.col("l_linenumber")).alias("cluster"))
    return drop_noise(marked).drop("cluster")


@query("noise_left_out_of_metrics", """
SELECT count(*) FILTER (c_nationkey % 4 = 0)::BIGINT AS noise_count, count(DISTINCT c_nationkey % 4) - 1 AS cluster_count FROM customer""")
def noise_left_out_of_metrics(spark, sf_dir):
    """Cluster metrics count noise rows and leave them out (M6)."""
    from tidemark.operators.prepare import vector_from_array

    cust = table(spark, sf_dir, "customer")
    rows = cust.select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 4 - 1).alias("cluster"), F.array(F.col("c_acctbal").cast("double")).alias("x"))
    m = clustering_metrics(vector_from_array(rows, "x"))
    return spark.createDataFrame([(m["noise_count"], m["cluster_count"])], "noise_count long, cluster_count long")


@query("top_scores", f"SELECT * FROM ({_MI_SQL}) ORDER BY mutual_information DESC, feature LIMIT 1")
def top_scores(spark, sf_dir):
    """The most informative column (F1, F2)."""
    from catalogue.analysis import _labeled_documents

    scores = an.mutual_information(_labeled_documents(spark, sf_dir), ["n_chars", "word_length"], "quality", "doc_id")
    return rounded(an.top_scores(scores, 1), ["mutual_information"])


@query("best_rows", "SELECT event_id, round(value, 6) AS confidence FROM (SELECT *, row_number() OVER (ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 25")
def best_rows(spark, sf_dir):
    """The rows a self-training pass takes by rank."""
    scored = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("confidence"))
    return rounded(scored.filter(st._accepted(scored, "k_best", 0.9, 25, "event_id")), ["confidence"])
