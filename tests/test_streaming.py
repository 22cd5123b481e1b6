"""Packets, buffer and count windows over file streams equal the batch results."""

import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.operators.windows import windowed_features
from tidemark.plans.session import shared_folder
from tidemark.streaming.buffer import StreamBuffer, start_stream
from tidemark.streaming.packets import packet_counts, parse_packets, project_fields, valid_samples
from tidemark.streaming.windows import WindowStream

CASES = {
    '{"timestamp":1.0,"s1":1}': 1, '[{"s1":2},{"s1":3}]': 2, "s1=4; s2=true;s3=null,s4=abc": 1, "": None, "junk": None, "=5": None, "3": None,
    "[1,2]": None, "  ": None, "[]": 0, '"text"': None, "a=1,a=2": 1, "k=v=w;": 1, '{"a":1': None, ";,": None, "null": None, '[{"a":1},3]': None,
}


def test_packets(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(CASES)], "i int, value string")
    parsed = parse_packets(df)
    got = {r["value"]: None if r["samples"] is None else len(r["samples"]) for r in parsed.collect()}
    assert got == CASES
    counts = packet_counts(parsed).first()
    assert counts["received"] == sum(v or 0 for v in CASES.values()) and counts["invalid"] == sum(v is None for v in CASES.values())
    rows = {r["value"]: r for r in parsed.collect()}
    pair = rows["s1=4; s2=true;s3=null,s4=abc"]
    assert pair["kinds"] == [{"s1": "long", "s2": "boolean", "s3": "null", "s4": "string"}] and pair["samples"][0]["s3"] is None
    assert rows["k=v=w;"]["samples"] == [{"k": "v=w"}] and rows["a=1,a=2"]["samples"] == [{"a": "2"}]
    fields = project_fields(valid_samples(parsed, ["i"]), {"s1": "bigint", "s2": "boolean", "s7": "double"}, ["i"]).orderBy("i", "s1").collect()
    assert [tuple(r) for r in fields[:4]] == [(0, 1, None, None), (1, 2, None, None), (1, 3, None, None), (2, 4, True, None)]


def test_buffer_keeps_the_newest_rows(spark):
    folder = f"{shared_folder(spark)}/test-buffer-{uuid.uuid4().hex}"
    buffer = StreamBuffer(spark, folder, 5)
    assert buffer.max_rows == 100
    for batch in range(3):
        rows = spark.range(batch * 60, batch * 60 + 60).withColumnRenamed("id", "n")
        if batch:
            rows = rows.withColumn("late", F.lit(1.0))
        buffer.append(rows, batch, ["n"])
    buffer.append(spark.range(120, 180).withColumnRenamed("id", "n").withColumn("late", F.lit(1.0)), 2, ["n"])  # the batch is replayed
    kept = buffer.read().orderBy("seq").collect()
    assert [r["seq"] for r in kept] == list(range(80, 180)) and kept[0]["n"] == 80
    notes = spark.createDataFrame([(10, "gone"), (150, "kept")], "row_index long, corrected_label string")
    assert [r["corrected_label"] for r in buffer.retain(notes).collect()] == ["kept"]
    assert buffer._parts().agg(F.min("seq")).first()[0] == 60  # the first part holds no kept row and is deleted


@pytest.mark.parametrize("size,overlap", [(6, 50), (5, 0), (10, 90)])
def test_stream_windows_equal_batch_windows(spark, size, overlap):
    folder = f"{shared_folder(spark)}/test-windows-{uuid.uuid4().hex}"
    df = spark.range(200).select(
        F.col("id").alias("t"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 4)).alias("key"),
        F.when(F.col("id") % 7 != 0, F.sin(F.col("id").cast("double"))).alias("x"))
    for lo, hi in ((0, 13), (13, 90), (90, 200)):
        df.filter((F.col("t") >= lo) & (F.col("t") < hi)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = WindowStream(spark, f"{folder}/state", "key", ["x"], ["mean", "zcr", "missing_count"], size, ["t"], overlap_pct=overlap)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{folder}/in")
    start_stream(source, stream.sink(), f"{folder}/checkpoint").awaitTermination()
    want = windowed_features(df, ["x"], ["mean", "zcr", "missing_count"], size, ["t"], ["key"], overlap_pct=overlap, window_type="Sliding", snake_names=True)
    tidy = lambda d: sorted((r["key"], r["window_number"], r["start_sample"], round(r["mean_x"], 9), round(r["zero_crossing_rate_x"], 9), r["missing_count_x"]) for r in d.collect())
    assert tidy(stream.windows()) == tidy(want)
