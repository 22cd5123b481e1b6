"""Profiling, cleaning, reverts, annotation, playback and scalar functions."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions.scalars import to_seconds
from tidemark.operators import charts, cleaning as cl
from tidemark.operators.annotate import annotation_log, corrected_dataset
from tidemark.operators.features import column_features
from tidemark.operators.playback import media_position, playback_interval
from tidemark.operators.profile import date_like_columns, missing_summary, quality_issues, remove_duplicate_rows, table_summary
from tidemark.operators.recipe import Dataset
from tidemark.sources.tables import available_columns, read_csv

KEYS = ["mean", "median", "std", "variance", "skew", "kurtosis", "rms", "energy", "zcr", "unique", "top", "freq", "missing_count", "missing_pct", "range", "count"]


def features(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, x double")
    return column_features(df, ["x"], KEYS, ["i"]).first().asDict()


def test_column_edge_cases(spark):
    got = features(spark, [5.0])
    assert (got["std"], got["skew"], got["kurtosis"], got["zcr"], got["mean"]) == (0.0, 0.0, 0.0, 0.0, 5.0)
    got = features(spark, [5.0, 5.0, 5.0, 5.0])
    assert (got["std"], got["variance"], got["skew"], got["kurtosis"], got["freq"], got["unique"]) == (0.0, 0.0, 0.0, 0.0, 4, 1)
    got = features(spark, [None, None])
    assert got["mean"] is None and got["std"] is None and got["skew"] is None and got["freq"] == 0 and got["missing_pct"] == 100.0
    got = features(spark, [1.0, 2.0, 2.0, 9.0, 9.0])
    assert got["skew"] == pytest.approx(0.5607, abs=1e-4) and got["kurtosis"] == pytest.approx(-3.2530, abs=1e-4)
    assert got["top"] == 2.0 and got["freq"] == 2 and got["median"] == 2.0
    assert features(spark, [1.0, None, -1.0, -2.0])["zcr"] == 0.5
    assert features(spark, [-0.0, 0.0, 1.0])["zcr"] == 0.5
    got = features(spark, [float("nan"), 1.0, 2.0])
    assert got["missing_count"] == 1 and got["mean"] == 1.5
    assert features(spark, [])["missing_pct"] == 0.0


def test_text_features(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",)], "s string")
    row = column_features(df, ["s"], ["top", "median", "range", "mean", "unique"]).first()
    assert (row["top"], row["median"], row["range"], row["mean"], row["unique"]) == ("a", "a", 2.0, None, 2)


def test_csv_mark_and_column_order(spark, tmp_path):
    path = tmp_path / "people.csv"
    lines = ["\ufeffid,name,kind,score"] + [f"{i},n{i},{'' if i == 3 else 'b' if i % 2 else 'a'},{i / 2}" for i in range(1, 11)]
    path.write_text("\n".join(lines), encoding="utf-8")
    df = read_csv(spark, str(path), ["score", "id"])
    assert df.columns == ["id", "score"] and df.count() == 10 and dict(df.dtypes) == {"id": "bigint", "score": "double"}
    assert available_columns(spark, str(path)) == ["id", "name", "kind", "score"]
    whole = read_csv(spark, str(path))
    assert cl.fill_missing(whole, "kind", "mode").filter("id = 3").first()["kind"] == "a"
    got = {r["metric"]: r["value"] for r in table_summary(whole).collect()}
    assert got == {"Rows": "10", "Columns": "4", "Missing Cells": "1", "Duplicate Rows": "0"}
    assert missing_summary(whole).filter("missing > 0").first()["missing_pct"] == "10.00%"


def test_scaling_of_constants(spark):
    df = spark.createDataFrame([(1.0, 7.0), (2.0, 7.0), (6.0, 7.0), (None, 7.0)], "x double, c double")
    rows = cl.standardize(df, ["x", "c"]).collect()
    assert rows[0]["x"] == pytest.approx(-0.9258201) and rows[3]["x"] is None and all(r["c"] == 0 for r in rows)
    rows = cl.normalize(df, ["x", "c"]).collect()
    assert [r["x"] for r in rows] == [0.0, 0.2, 1.0, None] and all(r["c"] == 0 for r in rows)


def test_impute_types(spark):
    df = spark.createDataFrame([(1, None, None, "a"), (2, 3.0, None, None), (None, 4.0, None, "a")], "i long, d double, n double, s string")
    out, changed = cl.impute(df, ["i", "d", "n", "s"], "mean")
    assert changed == ["i", "d"] and [r["i"] for r in out.collect()] == [1, 2, 2]  # 1.5 rounds half to even
    out, changed = cl.impute(df, ["s", "i"], "custom", {"s": "z", "i": "9"})
    assert sorted(changed) == ["i", "s"] and out.filter("i = 9 OR s = 'z'").count() == 2
    with pytest.raises(ValueError, match="No mode"):
        cl.fill_missing(df, "n", "mode")
    assert cl.parse_fill("yes", df.withColumn("b", F.lit(True)), "b") is True and cl.parse_fill("x", df, "i") == "x"


def test_cast_and_revert(spark):
    raw = spark.createDataFrame([(0, 1, 1.5), (1, 2, None), (2, 3, 3.25)], "rid long, a long, f double")
    text = cl.cast_column(raw, "a", "string")
    assert [r["a"] for r in cl.revert_cast(text, raw, ["a"], "rid").orderBy("rid").collect()] == [1, 2, 3]
    work = cl.cast_column(cl.cast_column(cl.apply_fill(raw, {"f": 2.0}), "f", "int", fraction="floor"), "f", "string")
    back = cl.revert_cast(work, raw, ["f"], "rid").orderBy("rid")
    assert [r["f"] for r in back.collect()] == [1.5, 2.0, 3.25] and dict(back.dtypes)["f"] == "double"
    with pytest.raises(ValueError):
        cl.cast_column(raw, "f", "int")
    assert not cl.can_convert(spark.createDataFrame([("1.5",)], "s string"), "s", "int")
    assert cl.can_convert(spark.createDataFrame([("2.0",)], "s string"), "s", "int")


def test_recipe_reverts_and_replays(spark):
    raw = spark.createDataFrame([(0, 1.0, "x"), (1, None, None), (2, 5.0, "y")], "rid long, v double, s string")
    data = Dataset(raw, "rid").impute(["v"], "mean").impute(["v"], "mean").standardize(["v"])
    assert [s.action for s in data.steps] == ["impute", "standardize"]
    back = data.revert("transform", ["v"]).working().orderBy("rid").collect()
    assert [r["v"] for r in back] == [1.0, 0.0, 5.0]
    gone = data.revert("imputation", ["v"]).drop_missing()
    assert gone.working().count() == 2
    assert Dataset(raw, "rid").replay(gone.recipe()).working().count() == 2
    assert data.active(use_raw=True).filter("v IS NULL").count() == 1


def test_duplicates_and_issues(spark):
    df = spark.createDataFrame([(0, 1, None), (1, 1, None), (2, 2, "b"), (3, 3, "c"), (4, 3, "c")], "rid long, a long, s string")
    issues = [(r["original_index"], r["issue"]) for r in quality_issues(df, "rid").collect()]
    assert issues == [(0, "Missing & Duplicate"), (1, "Missing & Duplicate"), (3, "Duplicate"), (4, "Duplicate")]
    assert [r["rid"] for r in remove_duplicate_rows(df, ["a", "s"]).collect()] == [2]
    assert sorted(r["rid"] for r in remove_duplicate_rows(df, ["a", "s"], "first", ["rid"]).collect()) == [0, 2, 3]


def test_date_columns(spark):
    df = spark.createDataFrame([("2024-01-01", "x", 1), ("2024-01-02", "y", 2)], "d string, s string, n long")
    assert sorted(r["column"] for r in date_like_columns(df, ["d", "s"]).collect()) == ["d"]


def test_annotations(spark):
    df = spark.createDataFrame([(i, f"t{i}", "old" if i == 3 else None) for i in range(4)], "rid long, event_time string, corrected_label string")
    entries = spark.createDataFrame([(1, "p", " a ", " n ", 1), (1, "p", "b", "", 2), (9, "p", "c", "", 3)], "row_index long, predicted_label string, corrected_label string, annotation_note string, seq int")
    log = annotation_log(df, entries, "rid")
    assert [tuple(r) for r in log.collect()] == [(1, "t1", "p", "b", "")]
    assert [r["corrected_label"] for r in corrected_dataset(df, log, "rid").orderBy("rid").collect()] == [None, "b", None, "old"]
    with pytest.raises(ValueError, match="required"):
        annotation_log(df, entries.withColumn("corrected_label", F.lit("  ")), "rid")


def test_playback_times(spark):
    df = spark.createDataFrame([(0, 10.0), (1, 10.5), (2, 40.0), (3, 39.0), (4, None), (5, 41.0)], "rid long, time double")
    got = [r["interval_ms"] for r in playback_interval(df, "rid", "time", 100, "s").orderBy("rid").collect()]
    assert got == [500, 10000, 100, 100, 100, 100]
    assert {r["interval_ms"] for r in playback_interval(df, "rid", "time", 100).collect()} == {100}  # seconds read as nanoseconds
    pos = [r["position_ms"] for r in media_position(df, "rid", "time", 40, 250).orderBy("rid").collect()]
    assert pos == [250, 750, 30250, 29250, None, 31250]


@pytest.mark.parametrize(
    "text,seconds",
    [("00:01:30", 90.0), ("1 days 00:00:01", 86401.0), ("5 min", 300.0), ("1970-01-02 00:00:00", 86400.0), ("1500000000", 1.5), ("junk", None), ("-00:00:02.5", -2.5)],
)
def test_text_seconds(spark, text, seconds):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(to_seconds(F.col("t"), "t", df.schema["t"].dataType).alias("s")).first()["s"] == seconds


def test_chart_rules(spark):
    df = spark.createDataFrame([(1, 2, 3), (2, 3, 4), (3, 4, 5)], "x long, y long, z long")
    with pytest.raises(ValueError, match="three different"):
        charts.scatter_points(df, ["x", "y", "x"])
    assert [r["code"] for r in charts.scatter_points(df, ["x", "y", "z"], "x").orderBy("x").collect()] == [0, 1, 2]
    rows = charts.histogram(df.withColumn("x", F.lit(4.0)), "x", 1).collect()
    assert len(rows) == 2 and rows[0]["left"] == 3.5 and sum(r["count"] for r in rows) == 3
    assert charts.chart_problem(df, "Grouped Box Plot", "x", "y").startswith("Grouped")
    with pytest.raises(ValueError, match="limit 20"):
        charts.class_separation(df.sparkSession.range(21).selectExpr("id a", "id b", "id l"), "a", "b", "l", limit=20)
    many = charts.class_separation(df.sparkSession.range(40).selectExpr("id a", "id b", "39 - id l"), "a", "b", "l")
    assert [r["code"] for r in many.orderBy("l").collect()] == list(range(40))
    box = charts.box_statistics(df.sparkSession.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 100)], "v double"), "v").first()
    assert (box["q1"], box["whisker_high"], box["outliers"]) == (2.0, 4.0, 1) and math.isclose(box["median"], 3.0)
