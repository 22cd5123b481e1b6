"""Cleaning, casts, reverts, row alignment, annotation, playback timing, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.common import SIGNAL_SQL, query, rnd, rounded, signal, table
from tidemark.functions.scalars import coerce_value, coerced_kind, to_seconds
from tidemark.operators import cleaning as cl
from tidemark.operators.annotate import annotation_log, corrected_dataset, upsert_annotations
from tidemark.operators.playback import media_position, playback_interval
from tidemark.operators.recipe import Dataset


def _sig(spark, sf_dir):
    """The signal with a rounded copy ``k`` of it as integer, missing in the same rows."""
    return signal(spark, sf_dir).select("event_id", "user_id", "event_type", "x", "y", F.floor("x").cast("bigint").alias("k"))


BASE = SIGNAL_SQL + ", s AS (SELECT event_id, user_id, event_type, x, y, floor(x)::BIGINT AS k FROM sig)"


@query("fill_mean", f"WITH {BASE} SELECT event_id, round(coalesce(x, (SELECT avg(x) FROM s)), 6) + 0.0::DOUBLE AS x FROM s")
def fill_mean(spark, sf_dir):
    """Missing values become the mean."""
    return rounded(cl.fill_missing(_sig(spark, sf_dir), "x", "mean").select("event_id", "x"), ["x"])


@query("fill_median", f"WITH {BASE} SELECT event_id, round(coalesce(x, (SELECT median(x) FROM s)), 6) + 0.0::DOUBLE AS x FROM s")
def fill_median(spark, sf_dir):
    """Missing values become the median."""
    return rounded(cl.fill_missing(_sig(spark, sf_dir), "x", "median").select("event_id", "x"), ["x"])


_MODE = "(SELECT min({0}) FROM (SELECT {0}, count(*) AS n, max(count(*)) OVER () AS mx FROM s WHERE {0} IS NOT NULL GROUP BY {0}) WHERE n = mx)"


@query("fill_mode", f"WITH {BASE} SELECT event_id, coalesce(k, {_MODE.format('k')}) AS k FROM s")
def fill_mode(spark, sf_dir):
    """Missing values become the smallest most frequent value."""
    return cl.fill_missing(_sig(spark, sf_dir), "k", "mode").select("event_id", "k")


@query("fill_constant", f"WITH {BASE} SELECT event_id, round(coalesce(x, -1.0::DOUBLE), 6) + 0.0::DOUBLE AS x FROM s")
def fill_constant(spark, sf_dir):
    """Missing values become a constant."""
    return rounded(cl.fill_missing(_sig(spark, sf_dir), "x", "constant", -1.0).select("event_id", "x"), ["x"])


@query("impute_typed", f"""WITH {BASE}, m AS (SELECT round_even(avg(k), 0)::BIGINT AS mk, avg(x) AS mx FROM s)
SELECT event_id, event_type, coalesce(k, mk) AS k, round(coalesce(x, mx), 6) + 0.0::DOUBLE AS x FROM s, m""")
def impute_typed(spark, sf_dir):
    """Several columns at once: integers round half to even, text is skipped."""
    out, _ = cl.impute(_sig(spark, sf_dir), ["k", "x", "event_type", "y"], "mean")
    return rounded(out.select("event_id", "event_type", "k", "x"), ["x"])


@query("standardize", f"""WITH {BASE}, m AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM s)
SELECT event_id, round((x - mx) / sx, 6) + 0.0::DOUBLE AS x, round((y - my) / sy, 6) + 0.0::DOUBLE AS y FROM s, m""")
def standardize_query(spark, sf_dir):
    """Population-deviation scaling; missing stays missing."""
    return rounded(cl.standardize(_sig(spark, sf_dir), ["x", "y"]).select("event_id", "x", "y"), ["x", "y"])


@query("normalize", f"""WITH {BASE}, m AS (SELECT min(x) AS a, max(x) AS b FROM s)
SELECT event_id, round((x - a) / (b - a), 8) + 0.0::DOUBLE AS x, 0.0::DOUBLE AS flat FROM s, m""")
def normalize_query(spark, sf_dir):
    """Scaling to the unit range; a constant column becomes 0."""
    sig = _sig(spark, sf_dir).withColumn("flat", F.lit(7.0))
    return rounded(cl.normalize(sig, ["x", "flat"]).select("event_id", "x", "flat"), ["x", "flat"], 8)


@query("cast_column", f"WITH {BASE} SELECT event_id, y::VARCHAR AS y_text, k::DOUBLE AS k_real, user_id::VARCHAR AS u_text FROM s")
def cast_column_query(spark, sf_dir):
    """Strict casts between the column types."""
    sig = _sig(spark, sf_dir).select("event_id", F.col("y").alias("y_text"), F.col("k").alias("k_real"), F.col("user_id").alias("u_text"))
    sig = cl.cast_column(sig, "y_text", "string")
    sig = cl.cast_column(sig, "k_real", "float64")
    return cl.cast_column(sig, "u_text", "str")


@query("cast_coerced", """SELECT c_custkey, try_cast(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_acctbal::VARCHAR END AS DOUBLE) AS n,
  CASE WHEN c_acctbal > 0 THEN TRUE WHEN c_acctbal < -500 THEN NULL ELSE FALSE END AS flag FROM customer""")
def cast_coerced(spark, sf_dir):
    """What does not fit the type becomes missing."""
    cust = table(spark, sf_dir, "customer")
    text = F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise(F.col("c_acctbal").cast("string"))
    flag = F.when(F.col("c_acctbal") > 0, "True").when(F.col("c_acctbal") < -500, "unknown").otherwise("False")
    out = cust.select("c_custkey", text.alias("n"), flag.alias("flag"))
    return cl.cast_column(cl.cast_column(out, "n", "float", coerce=True), "flag", "bool", coerce=True)


@query("cast_ceil_floor", f"WITH {BASE} SELECT event_id, ceil(x)::BIGINT AS up, floor(y)::BIGINT AS down FROM s")
def cast_ceil_floor(spark, sf_dir):
    """Fractional values on the way to integers: round up or down."""
    sig = _sig(spark, sf_dir).select("event_id", F.col("x").alias("up"), F.col("y").alias("down"))
    return cl.cast_column(cl.cast_column(sig, "up", "int", fraction="ceil"), "down", "int", fraction="floor")


@query("revert_imputation", f"WITH {BASE} SELECT event_id, round(x, 6) + 0.0::DOUBLE AS x, k FROM s")
def revert_imputation_query(spark, sf_dir):
    """Imputed cells are missing again, joined by row id (C11, H1)."""
    raw = _sig(spark, sf_dir)
    work, _ = cl.impute(raw, ["x", "k"], "median")
    return rounded(cl.revert_imputation(work, raw, ["x", "k"], "event_id").select("event_id", "x", "k"), ["x"])


@query("revert_cast", f"""WITH {BASE}, m AS (SELECT round_even(avg(k), 0)::BIGINT AS mk FROM s)
SELECT event_id, coalesce(k, mk) AS k, round(coalesce(x, 12.5::DOUBLE), 6) + 0.0::DOUBLE AS x FROM s, m""")
def revert_cast_query(spark, sf_dir):
    """Type and values come back, imputed values stay."""
    raw = _sig(spark, sf_dir)
    work, _ = cl.impute(raw, ["k"], "mean")
    work = cl.apply_fill(work, {"x": 12.5})
    work = cl.cast_column(cl.cast_column(work, "k", "string"), "x", "string")
    out = cl.revert_cast(work, raw, ["k", "x"], "event_id")
    return rounded(out.select("event_id", "k", "x"), ["x"])


@query("revert_transform", f"""WITH {BASE}, m AS (SELECT avg(x) AS mx FROM s)
SELECT event_id, round(coalesce(x, (mx - mx)), 6) + 0.0::DOUBLE AS x FROM s, m""")
def revert_transform_query(spark, sf_dir):
    """Scaling is undone, imputed cells keep their (scaled) value."""
    raw = _sig(spark, sf_dir)
    work, _ = cl.impute(raw, ["x"], "mean")
    work = cl.standardize(work, ["x"])
    return rounded(cl.revert_transform(work, raw, ["x"], "event_id").select("event_id", "x"), ["x"])


@query("recipe_replay", f"""WITH {BASE}, f AS (SELECT event_id, event_type, x, coalesce(k, (SELECT round_even(avg(k), 0)::BIGINT FROM s)) AS k,
  (y - (SELECT avg(y) FROM s)) / (SELECT stddev_pop(y) FROM s) AS y FROM s)
SELECT event_id, event_type, k, round(y, 6) + 0.0::DOUBLE AS y, round(x, 6) + 0.0::DOUBLE AS x FROM f WHERE x IS NOT NULL""")
def recipe_replay(spark, sf_dir):
    """A recorded recipe replayed on the raw table: impute, scale, revert, drop (C14)."""
    data = Dataset(_sig(spark, sf_dir), "event_id")
    made = data.impute(["k", "x"], "mean").standardize(["y", "x"]).drop_columns(["user_id", "nothing"])
    made = made.revert("transform", ["x"]).revert("imputation", ["x"]).drop_missing()
    again = data.replay(made.recipe()).working()
    return rounded(again.select("event_id", "event_type", "k", "y", "x"), ["y", "x"])


@query("reselect_columns", f"""WITH {BASE} SELECT event_id, event_type, round(x, 6) + 0.0::DOUBLE AS x, round(y, 6) + 0.0::DOUBLE AS y FROM s WHERE x IS NOT NULL""")
def reselect_columns_query(spark, sf_dir):
    """A dropped column comes back by row id for the rows that are left."""
    raw = _sig(spark, sf_dir)
    work = cl.drop_columns(raw, ["event_type", "y", "no_such_column"]).dropna(subset=["x"])
    return rounded(cl.reselect_columns(work, raw, ["event_type", "x", "y"], "event_id"), ["x", "y"])


@query("append_rows", f"""WITH {BASE} SELECT event_id, round(x, 6) + 0.0::DOUBLE AS x, NULL::VARCHAR AS note FROM s WHERE x IS NOT NULL
UNION ALL SELECT event_id, NULL, event_type FROM s WHERE x IS NULL""")
def append_rows_query(spark, sf_dir):
    """Two tables with different columns under the union of their columns."""
    sig = _sig(spark, sf_dir)
    old = sig.filter("x IS NOT NULL").select("event_id", "x")
    new = sig.filter("x IS NULL").select("event_id", F.col("event_type").alias("note"))
    return rounded(cl.append_rows(old, new), ["x"])


@query("infinite_to_missing", "SELECT event_id, CASE WHEN event_type = 'click' THEN NULL ELSE round(value, 6) + 0.0::DOUBLE END AS v FROM events")
def infinite_to_missing_query(spark, sf_dir):
    """Infinities count as missing for charts."""
    ev = table(spark, sf_dir, "events")
    v = F.when(F.col("event_type") == "click", F.lit(float("inf"))).otherwise(F.col("value"))
    return rounded(cl.infinite_to_missing(ev.select("event_id", v.alias("v")), ["v"]), ["v"])


_ENTRIES = """
e AS (SELECT event_id AS row_index, event_type AS predicted_label, trim('  ' || CASE WHEN value > 50 THEN 'high' ELSE 'low' END || ' ') AS corrected_label,
      'first pass' AS annotation_note, 1 AS seq FROM events WHERE event_type = 'error'
      UNION ALL SELECT event_id, event_type, 'checked', 'again', 2 FROM events WHERE event_type = 'error' AND value > 50),
log AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY row_index ORDER BY seq DESC) = 1)"""


def _entries(spark, sf_dir):
    bad = table(spark, sf_dir, "events").filter("event_type = 'error'")
    first = bad.select(
        F.col("event_id").alias("row_index"), F.col("event_type").alias("predicted_label"),
        F.concat(F.lit("  "), F.when(F.col("value") > 50, "high").otherwise("low"), F.lit(" ")).alias("corrected_label"),
        F.lit(" first pass ").alias("annotation_note"), F.lit(1).alias("seq"))
    again = bad.filter("value > 50").select(
        F.col("event_id").alias("row_index"), F.col("event_type").alias("predicted_label"),
        F.lit("checked").alias("corrected_label"), F.lit("again").alias("annotation_note"), F.lit(2).alias("seq"))
    outside = first.select((F.col("row_index") + 100_000_000).alias("row_index"), *first.columns[1:])
    return first.unionByName(again), outside


@query("annotation_log", f"""WITH {_ENTRIES} SELECT row_index, row_index::VARCHAR AS timestamp, predicted_label, corrected_label, annotation_note FROM log""")
def annotation_log_query(spark, sf_dir):
    """The latest annotation of a row wins, text is trimmed, ids outside are ignored (H2, P5)."""
    entries, outside = _entries(spark, sf_dir)
    ev = table(spark, sf_dir, "events").select("event_id", "value")
    return annotation_log(ev, entries.unionByName(outside), "event_id")


@query("annotation_upsert", f"""WITH {_ENTRIES} SELECT row_index, row_index::VARCHAR AS timestamp, predicted_label, corrected_label, annotation_note FROM log""")
def annotation_upsert(spark, sf_dir):
    """A later log laid over an earlier one (H2)."""
    entries, _ = _entries(spark, sf_dir)
    ev = table(spark, sf_dir, "events").select("event_id", "value")
    first = annotation_log(ev, entries.filter("seq = 1"), "event_id")
    return upsert_annotations(first, annotation_log(ev, entries.filter("seq = 2"), "event_id"))


@query("corrected_dataset", f"""WITH {_ENTRIES} SELECT event_id, ev.event_type, coalesce(log.corrected_label, CASE WHEN value > 200 THEN 'kept' END) AS corrected_label
FROM events ev LEFT JOIN log ON log.row_index = event_id""")
def corrected_dataset_query(spark, sf_dir):
    """Corrections overlay the table, earlier ones stay (H3, P5)."""
    entries, _ = _entries(spark, sf_dir)
    ev = table(spark, sf_dir, "events").withColumn("corrected_label", F.when(F.col("value") > 200, "kept"))
    log = annotation_log(ev, entries, "event_id")
    return corrected_dataset(ev, log, "event_id").select("event_id", "event_type", "corrected_label")


@query("playback_interval", """
WITH d AS (SELECT event_id, user_id, ts, lead(ts) OVER (ORDER BY event_id) AS nx FROM events),
m AS (SELECT event_id, (epoch_us(nx) - epoch_us(ts)) // 1000 AS ms, nx FROM d)
SELECT event_id, (CASE WHEN nx IS NULL THEN 250 ELSE greatest(10, least(CASE WHEN ms > 0 THEN ms ELSE 250 END, 10000)) END)::BIGINT AS interval_ms FROM m""")
def playback_interval_query(spark, sf_dir):
    """Delay to the next row with bounds and fallback."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts")
    return playback_interval(ev, "event_id", "ts", 250).select("event_id", "interval_ms")


@query("media_position", """
WITH f AS (SELECT arg_min(epoch_us(ts), event_id) AS o FROM events)
SELECT event_id, greatest(0, round_even(greatest(0.0::DOUBLE, epoch_us(ts) / 1e6::DOUBLE - o / 1e6::DOUBLE) * 1000.0::DOUBLE, 0)::BIGINT - 1500)::BIGINT AS position_ms,
  greatest(0, event_id * 40 - 1500)::BIGINT AS by_row FROM events, f""")
def media_position_query(spark, sf_dir):
    """Media position by timestamp and by row number."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts")
    out = media_position(ev, "event_id", "ts", 40, -1500)
    return media_position(out, "event_id", None, 40, -1500, "by_row").select("event_id", "position_ms", "by_row")


@query("to_seconds", """
WITH t AS (SELECT event_id, ts, epoch_us(ts) AS us FROM events)
SELECT event_id, round(us / 1e6::DOUBLE, 3) AS stamp, round(us / 1e6::DOUBLE, 3) AS from_ns_name, round(us / 1e6::DOUBLE, 3) AS from_us_size,
  round((us // 1000) / 1e3::DOUBLE, 3) AS from_ms_size, (us // 1000000)::DOUBLE AS plain, (us // 1000000)::DOUBLE AS from_text,
  (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::DOUBLE AS from_clock FROM t""")
def to_seconds_query(spark, sf_dir):
    """Seconds from timestamps, numbers in several units, dates and clock text (O1)."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    ev = ev.select(
        "event_id", "ts", (F.col("us") * 1000).alias("clock_ns"), "us", F.floor(F.col("us") / 1000).alias("ms"), F.floor(F.col("us") / 1000000).alias("sec"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("text"), F.date_format("ts", "HH:mm:ss").alias("clock"))

    def sec(name, as_name=None):
        return to_seconds(F.col(name), as_name or name, ev.schema[name].dataType)

    return ev.select(
        "event_id", rnd(sec("ts"), 3).alias("stamp"), rnd(sec("clock_ns"), 3).alias("from_ns_name"), rnd(sec("us", "t"), 3).alias("from_us_size"),
        rnd(sec("ms", "t"), 3).alias("from_ms_size"), sec("sec", "t").alias("plain"), sec("text").alias("from_text"), sec("clock").alias("from_clock"))


@query("coerce_values", """
WITH v AS (SELECT event_id, CASE event_type WHEN 'click' THEN event_id::VARCHAR WHEN 'error' THEN value::VARCHAR WHEN 'view' THEN 'TRUE'
  WHEN 'signup' THEN 'None' ELSE event_type END AS raw FROM events)
SELECT event_id, CASE WHEN lower(raw) IN ('true', 'false') THEN 'boolean' WHEN lower(raw) IN ('null', 'none') THEN 'null'
   WHEN try_cast(raw AS BIGINT) IS NOT NULL AND raw NOT LIKE '%.%' THEN 'long' WHEN try_cast(raw AS DOUBLE) IS NOT NULL THEN 'double' ELSE 'string' END AS kind,
  round(try_cast(raw AS DOUBLE), 6) AS as_double, CASE WHEN raw NOT LIKE '%.%' THEN try_cast(raw AS BIGINT) END AS as_long,
  CASE lower(raw) WHEN 'true' THEN TRUE WHEN 'false' THEN FALSE END AS as_bool, CASE WHEN lower(raw) NOT IN ('null', 'none') THEN raw END AS as_text FROM v""")
def coerce_values(spark, sf_dir):
    """Raw packet text in declared types (O2)."""
    ev = table(spark, sf_dir, "events")
    raw = (
        F.when(F.col("event_type") == "click", F.col("event_id").cast("string")).when(F.col("event_type") == "error", F.col("value").cast("string"))
        .when(F.col("event_type") == "view", "TRUE").when(F.col("event_type") == "signup", "None").otherwise(F.col("event_type")))
    ev = ev.select("event_id", raw.alias("raw"))
    x = F.col("raw")
    return ev.select("event_id", coerced_kind(x).alias("kind"), rnd(coerce_value(x, "double")).alias("as_double"), coerce_value(x, "bigint").alias("as_long"),
                     coerce_value(x, "boolean").alias("as_bool"), coerce_value(x, "string").alias("as_text"))
