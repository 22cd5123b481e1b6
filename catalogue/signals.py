"""Windows, per-column features and profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.common import SIGNAL_SQL, query, rnd, rounded, signal, table
from tidemark.functions.stat_keys import KEY_LABELS
from tidemark.operators.features import column_features, describe_columns
from tidemark.operators.profile import (
    date_like_columns,
    drop_missing_rows,
    flag_duplicate_rows,
    flag_missing_rows,
    missing_counts,
    missing_summary,
    quality_issues,
    remove_duplicate_rows,
    remove_rows,
    split_labeled,
    table_summary,
)
from tidemark.operators.windows import trailing_window, window_layout, window_table, windowed_features
from tidemark.plans.ordered import with_row_id
from tidemark.sources.tables import flatten_matrix

ORDER = ["ts", "event_id"]


def windows_sql(size: int, step: int, partial: bool, entity: bool = True) -> str:
    """Rows of every valid window: (user_id, w, i, x, y)."""
    part = "PARTITION BY user_id" if entity else ""
    key = "user_id" if entity else "0 AS user_id"
    keep = "TRUE" if partial else "FALSE"
    return f"""
{SIGNAL_SQL},
idx AS (SELECT {key}, row_number() OVER ({part} ORDER BY ts, event_id) - 1 AS i, x, y FROM sig),
len AS (SELECT user_id, count(*) AS n, CASE WHEN count(*) >= {size} THEN (count(*) - {size}) // {step} + 1 ELSE 0 END AS nfull
        FROM idx GROUP BY user_id),
win AS (SELECT user_id, w, w * {step} AS s, least(w * {step} + {size}, n) AS e
        FROM (SELECT user_id, n, nfull, unnest(range(0, nfull + CASE WHEN {keep} AND nfull * {step} < n THEN 1 ELSE 0 END)) AS w FROM len)),
wr AS (SELECT win.user_id, win.w, win.s, win.e, idx.i, idx.x, idx.y
       FROM win JOIN idx ON idx.user_id = win.user_id AND idx.i >= win.s AND idx.i < win.e)
"""


def features_sql(size: int, step: int, partial: bool, columns: str = "xy") -> str:
    """All windowed statistics of the chosen columns from first principles."""
    parts = [windows_sql(size, step, partial)]
    names = []
    for v in columns:
        parts.append(f""",
z_{v} AS (SELECT user_id, w, sum(CASE WHEN signbit(v) <> signbit(p) THEN 1 ELSE 0 END) AS ch FROM (
   SELECT user_id, w, {v} AS v, lag({v}) OVER (PARTITION BY user_id, w ORDER BY i) AS p FROM wr WHERE {v} IS NOT NULL)
   WHERE p IS NOT NULL GROUP BY user_id, w),
f_{v} AS (SELECT user_id, w, count(*) AS uniq, max(f) AS freq, min(v) FILTER (f = mf) AS top FROM (
   SELECT user_id, w, {v} AS v, count(*) AS f, max(count(*)) OVER (PARTITION BY user_id, w) AS mf
   FROM wr WHERE {v} IS NOT NULL GROUP BY user_id, w, {v}) GROUP BY user_id, w),
m_{v} AS (SELECT user_id, w, min(s) AS s, max(e) AS e, count(*) AS nrows, count({v}) AS n, avg({v}) AS mean, median({v}) AS median,
   stddev_samp({v}) AS sd, var_pop({v}) AS vp, min({v}) AS mn, max({v}) AS mx,
   avg({v} * {v}) AS msq, sum({v} * {v}) AS ssq FROM wr GROUP BY user_id, w),
c_{v} AS (SELECT wr.user_id, wr.w, avg(({v} - mean) ** 3) AS c3, avg(({v} - mean) ** 4) AS c4
   FROM wr JOIN m_{v} m ON m.user_id = wr.user_id AND m.w = wr.w GROUP BY wr.user_id, wr.w)""")
        names.append(f"""
  round(m_{v}.mean, 6) + 0.0::DOUBLE AS mean_{v}, round(m_{v}.median, 6) + 0.0::DOUBLE AS median_{v},
  round(CASE WHEN m_{v}.n = 1 THEN 0 ELSE m_{v}.sd END, 6) + 0.0::DOUBLE AS standard_deviation_{v},
  round(sqrt(m_{v}.vp), 6) + 0.0::DOUBLE AS variance_root_{v}, round(m_{v}.mn, 6) + 0.0::DOUBLE AS min_{v}, round(m_{v}.mx, 6) + 0.0::DOUBLE AS max_{v},
  round(m_{v}.mx - m_{v}.mn, 6) + 0.0::DOUBLE AS range_{v},
  round(CASE WHEN m_{v}.n = 0 THEN NULL WHEN m_{v}.n <= 2 OR m_{v}.vp <= 1e-24 THEN 0 ELSE c_{v}.c3 / m_{v}.vp ** 1.5 END, 6) + 0.0::DOUBLE AS skewness_{v},
  round(CASE WHEN m_{v}.n = 0 THEN NULL WHEN m_{v}.n <= 3 OR m_{v}.vp <= 1e-24 THEN 0 ELSE c_{v}.c4 / m_{v}.vp ** 2 - 3 END, 6) + 0.0::DOUBLE AS kurtosis_{v},
  round(sqrt(m_{v}.msq), 6) + 0.0::DOUBLE AS rms_{v}, round(m_{v}.ssq, 4) + 0.0::DOUBLE AS energy_{v},
  round(m_{v}.mx - m_{v}.mn, 6) + 0.0::DOUBLE AS peak_to_peak_{v},
  round(CASE WHEN m_{v}.n = 0 THEN NULL WHEN m_{v}.n < 2 THEN 0 ELSE z_{v}.ch::DOUBLE / (m_{v}.n - 1) END, 6) + 0.0::DOUBLE AS zero_crossing_rate_{v},
  coalesce(f_{v}.uniq, 0)::BIGINT AS unique_{v}, round(f_{v}.top, 6) + 0.0::DOUBLE AS top_{v}, coalesce(f_{v}.freq, 0)::BIGINT AS frequency_{v},
  (m_{v}.nrows - m_{v}.n)::BIGINT AS missing_count_{v},
  round((m_{v}.nrows - m_{v}.n) * 100.0::DOUBLE / m_{v}.nrows, 6) + 0.0::DOUBLE AS missing_percentage_{v}""")
    base = columns[0]
    joins = " ".join(
        ("" if v == base else f" JOIN m_{v} USING (user_id, w)")
        + f" JOIN c_{v} USING (user_id, w) LEFT JOIN z_{v} USING (user_id, w) LEFT JOIN f_{v} USING (user_id, w)"
        for v in columns
    )
    return (
        "WITH " + "".join(parts)
        + f" SELECT user_id, (w + 1)::BIGINT AS window_number, m_{base}.s::BIGINT AS start_sample, (m_{base}.e - 1)::BIGINT AS end_sample,"
        + ",".join(names) + f" FROM m_{base} {joins}"
    )


def _windowed(spark, sf_dir, size, overlap, partial, columns="xy", kind="Sliding Windows"):
    out = windowed_features(
        signal(spark, sf_dir), list(columns), list(KEY_LABELS), size, ORDER, ["user_id"],
        overlap_pct=overlap, window_type=kind, keep_partial=partial, snake_names=True,
    )
    whole = {f"{k}_{v}" for v in columns for k in ("unique", "frequency", "missing_count")} | {"user_id", "window_number", "start_sample", "end_sample"}
    for v in columns:
        out = out.withColumn(f"energy_{v}", rnd(f"energy_{v}", 4))
        # the root has no decimal ties, so both sides round alike
        out = out.withColumn(f"variance_{v}", F.sqrt(f"variance_{v}")).withColumnRenamed(f"variance_{v}", f"variance_root_{v}")
    return rounded(out, [n for n in out.columns if n not in whole and not n.startswith("energy")])


@query("windowed_features_sliding", features_sql(20, 10, False))
def windowed_features_sliding(spark, sf_dir):
    """Twenty-sample windows at 50 % overlap per user, every statistic."""
    return _windowed(spark, sf_dir, 20, 50, False)


@query("windowed_features_partial", features_sql(20, 13, True, "x"))
def windowed_features_partial(spark, sf_dir):
    """Overlap that does not divide the window, with the trailing partial window kept."""
    return _windowed(spark, sf_dir, 20, 35, True, "x")


@query("windowed_features_fixed", features_sql(25, 25, True, "x"))
def windowed_features_fixed(spark, sf_dir):
    """Fixed windows ignore the overlap setting."""
    return _windowed(spark, sf_dir, 25, 50, True, "x", "Fixed Windows")


@query("windowed_features_whole_series", "WITH " + windows_sql(100, 9, False, entity=False) + """
SELECT (w + 1)::BIGINT AS window_number, min(s)::BIGINT AS start_sample, (max(e) - 1)::BIGINT AS end_sample,
  round(min(s) / 2.0::DOUBLE, 6) AS start_time_s, round((max(e) - 1) / 2.0::DOUBLE, 6) AS end_time_s,
  round(avg(y), 6) + 0.0::DOUBLE AS mean_y, round(stddev_samp(y), 6) + 0.0::DOUBLE AS standard_deviation_y
FROM wr GROUP BY w""")
def windowed_features_whole_series(spark, sf_dir):
    """One series without an entity, window given in seconds, 90 % overlap (step truncates to 9)."""
    out = windowed_features(
        signal(spark, sf_dir), ["y"], ["mean", "std"], 50, ORDER, unit="seconds", sample_rate_hz=2.0,
        overlap_pct=90, window_type="Sliding Windows", snake_names=True,
    )
    return rounded(out, ["start_time_s", "end_time_s", "mean_y", "standard_deviation_y"])


@query("window_index_table", """
WITH len AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id),
f AS (SELECT user_id, n, CASE WHEN n >= 20 THEN (n - 20) // 10 + 1 ELSE 0 END AS nf FROM len),
w AS (SELECT user_id, n, unnest(range(0, nf + CASE WHEN nf * 10 < n THEN 1 ELSE 0 END)) AS w FROM f)
SELECT user_id, (w + 1)::BIGINT AS window_number, (w * 10)::BIGINT AS start_sample, (least(w * 10 + 20, n) - 1)::BIGINT AS end_sample,
  (least(w * 10 + 20, n) - w * 10)::BIGINT AS window_samples,
  (w * 10)::DOUBLE / 4 AS start_time_s, (least(w * 10 + 20, n) - 1)::DOUBLE / 4 AS end_time_s FROM w""")
def window_index_table(spark, sf_dir):
    """Closed-form index of all windows of each user."""
    lengths = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    layout = window_layout(5, "seconds", 50, "Sliding Windows", True, 4.0)
    out = window_table(lengths, "n", layout, ["user_id"])
    return out.toDF("user_id", "window_number", "start_sample", "end_sample", "window_samples", "start_time_s", "end_time_s")


@query("trailing_signal_window", f"""
WITH {SIGNAL_SQL}, idx AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, y FROM sig)
SELECT user_id, i::BIGINT AS row_id, (count(*) OVER w)::BIGINT AS samples, round(sum(y) OVER w, 4) + 0.0::DOUBLE AS total
FROM idx WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN 10 PRECEDING AND CURRENT ROW)""")
def trailing_signal_window(spark, sf_dir):
    """Each sample with the ten before it (E8), summarised for comparison."""
    base = with_row_id(signal(spark, sf_dir).select("user_id", "ts", "event_id", "y"), ORDER, ["user_id"])
    out = trailing_window(base, ["y"], 10, "row_id", ["user_id"])
    total = F.aggregate("signal_window", F.lit(0.0), lambda acc, s: acc + s["y"])
    return out.select("user_id", "row_id", F.size("signal_window").cast("bigint").alias("samples"), rnd(total, 4).alias("total"))


@query("row_identity", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  (row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) - 1)::BIGINT AS row_id
FROM lineitem""")
def row_identity(spark, sf_dir):
    """Dense row numbers over a whole table without a global window."""
    li = table(spark, sf_dir, "lineitem")
    by = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate"]
    return with_row_id(li.select(*by), by).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "row_id")


def _column_feature_sql(cols: list[tuple[str, str]], source: str, order: str) -> str:
    blocks = []
    for name, expr in cols:
        blocks.append(f"""
SELECT '{name}' AS signal, (SELECT count({expr}) FROM {source})::BIGINT AS count,
  round(m.mean, 6) + 0.0::DOUBLE AS mean, round(m.med, 6) + 0.0::DOUBLE AS median, round(m.sd, 6) + 0.0::DOUBLE AS std,
  round(m.vp, 4) + 0.0::DOUBLE AS variance, round(m.mn, 6) + 0.0::DOUBLE AS min, round(m.mx, 6) + 0.0::DOUBLE AS max, round(m.mx - m.mn, 6) + 0.0::DOUBLE AS range,
  round(m.sk, 6) + 0.0::DOUBLE AS skew, round(m.ku, 6) + 0.0::DOUBLE AS kurtosis, round(sqrt(m.msq), 6) + 0.0::DOUBLE AS rms,
  round(m.msq, 4) + 0.0::DOUBLE AS energy_per_row, round(m.mx - m.mn, 6) + 0.0::DOUBLE AS p2p,
  round(z.zcr, 8) + 0.0::DOUBLE AS zcr, f.uniq::BIGINT AS unique, round(f.top, 6) + 0.0::DOUBLE AS top, f.freq::BIGINT AS freq,
  m.miss::BIGINT AS missing_count, round(m.miss * 100.0::DOUBLE / m.nr, 6) + 0.0::DOUBLE AS missing_pct
FROM (SELECT count(*) AS nr, count(*) - count({expr}) AS miss, avg({expr}) AS mean, median({expr}) AS med, stddev_samp({expr}) AS sd, var_pop({expr}) AS vp,
        min({expr}) AS mn, max({expr}) AS mx, skewness({expr}) AS sk, kurtosis({expr}) AS ku, avg(({expr})::DOUBLE * ({expr})) AS msq FROM {source}) m,
 (SELECT sum(CASE WHEN signbit(v) <> signbit(p) THEN 1 ELSE 0 END)::DOUBLE / count(*) AS zcr FROM (
    SELECT ({expr})::DOUBLE AS v, lag(({expr})::DOUBLE) OVER (ORDER BY {order}) AS p FROM {source} WHERE ({expr}) IS NOT NULL) WHERE p IS NOT NULL) z,
 (SELECT count(*) AS uniq, max(n) AS freq, min(v) FILTER (n = mx) AS top FROM (
    SELECT {expr} AS v, count(*) AS n, max(count(*)) OVER () AS mx FROM {source} WHERE ({expr}) IS NOT NULL GROUP BY 1)) f""")
    return " UNION ALL ".join(blocks)


@query("column_features", f"WITH {SIGNAL_SQL} " + _column_feature_sql([("x", "x"), ("y", "y")], "sig", "ts, event_id"))
def column_features_query(spark, sf_dir):
    """Every whole-column statistic of two signals (D5-D16, D13 bias-corrected)."""
    keys = ["count", "mean", "median", "std", "variance", "min", "max", "range", "skew", "kurtosis", "rms", "energy", "p2p", "zcr",
            "unique", "top", "freq", "missing_count", "missing_pct"]
    out = column_features(signal(spark, sf_dir), ["x", "y"], keys, ORDER)
    out = out.withColumn("energy_per_row", rnd(F.col("energy") / F.col("count"), 4)).drop("energy")
    out = out.withColumn("variance", rnd("variance", 4)).withColumn("zcr", rnd("zcr", 8))
    return rounded(out, ["mean", "median", "std", "min", "max", "range", "skew", "kurtosis", "rms", "p2p", "top", "missing_pct"])


@query("column_features_text", """
WITH f AS (SELECT 'o_orderpriority' AS signal, o_orderpriority AS v FROM orders UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders),
g AS (SELECT signal, v, count(*) AS n, max(count(*)) OVER (PARTITION BY signal) AS mx FROM f WHERE v IS NOT NULL GROUP BY 1, 2)
SELECT signal, sum(n)::BIGINT AS count, count(*)::BIGINT AS unique, min(v) FILTER (n = mx) AS top, max(n)::BIGINT AS freq,
  min(v) FILTER (n = mx) AS median, count(*)::DOUBLE AS range, NULL::DOUBLE AS mean, 0::BIGINT AS missing_count FROM g GROUP BY signal""")
def column_features_text(spark, sf_dir):
    """Text signals: median is the mode, range the distinct count."""
    keys = ["count", "unique", "top", "freq", "median", "range", "mean", "missing_count"]
    return column_features(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"], keys)


@query("describe_columns", f"""
WITH {SIGNAL_SQL}, m AS (SELECT count(*) AS nr, count(x) AS n, avg(x) AS mean, stddev_samp(x) AS sd, min(x) AS mn, max(x) AS mx,
  quantile_cont(x, 0.25) AS q1, median(x) AS q2, quantile_cont(x, 0.75) AS q3, var_pop(x) AS vp, avg(x * x) AS msq FROM sig),
c AS (SELECT avg((x - mean) ** 3) AS c3, avg((x - mean) ** 4) AS c4 FROM sig, m),
t AS (SELECT event_type AS v, count(*) AS n, max(count(*)) OVER () AS mx FROM sig GROUP BY 1)
SELECT 'x' AS signal, n::BIGINT AS count, NULL::BIGINT AS unique, NULL::VARCHAR AS top, NULL::BIGINT AS freq,
  round(mean, 6) + 0.0::DOUBLE AS mean, round(sd, 6) + 0.0::DOUBLE AS std, round(mn, 6) AS min, round(q1, 6) AS p25, round(q2, 6) AS p50, round(q3, 6) AS p75,
  round(mx, 6) AS max, round(c3 / vp ** 1.5, 6) AS skew, round(c4 / vp ** 2 - 3, 6) AS kurtosis, round(sqrt(msq), 6) AS rms, round(mx - mn, 6) AS p2p,
  round(vp, 4) AS variance, n::BIGINT AS total_non_null, (nr - n)::BIGINT AS missing_count, round((nr - n) * 100.0::DOUBLE / nr, 6) AS missing_pct
FROM m, c
UNION ALL SELECT 'event_type', sum(n)::BIGINT, count(*)::BIGINT, min(v) FILTER (n = mx), max(n)::BIGINT, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
  sum(n)::BIGINT, 0::BIGINT, 0.0::DOUBLE FROM t""")
def describe_columns_query(spark, sf_dir):
    """Description of a numeric and a text column."""
    out = describe_columns(signal(spark, sf_dir), ["x", "event_type"])
    out = out.withColumn("variance", rnd("variance", 4))
    return rounded(out, ["mean", "std", "min", "p25", "p50", "p75", "max", "skew", "kurtosis", "rms", "p2p", "missing_pct"])


@query("table_summary", f"""
WITH {SIGNAL_SQL}, s AS (SELECT user_id, event_type, x FROM sig)
SELECT 'Rows' AS metric, count(*)::VARCHAR AS value FROM s UNION ALL SELECT 'Columns', '3'
UNION ALL SELECT 'Missing Cells', (count(*) - count(x))::VARCHAR FROM s
UNION ALL SELECT 'Duplicate Rows', ((SELECT count(*) FROM s) - (SELECT count(*) FROM (SELECT DISTINCT * FROM s)))::VARCHAR""")
def table_summary_query(spark, sf_dir):
    """Rows, columns, missing cells and duplicate rows."""
    return table_summary(signal(spark, sf_dir).select("user_id", "event_type", "x"))


@query("missing_summary", f"""
WITH {SIGNAL_SQL}, n AS (SELECT count(*) AS r, count(*) - count(x) AS m FROM sig)
SELECT 'user_id' AS "column", 'bigint' AS dtype, 0::BIGINT AS missing, '0.00%' AS missing_pct
UNION ALL SELECT 'event_type', 'string', 0::BIGINT, '0.00%'
UNION ALL SELECT 'x', 'double', m::BIGINT, printf('%.2f%%', m * 100.0::DOUBLE / r) FROM n""")
def missing_summary_query(spark, sf_dir):
    """Type and missing share of each column."""
    return missing_summary(signal(spark, sf_dir).select("user_id", "event_type", "x"))


@query("missing_counts", f"""WITH {SIGNAL_SQL} SELECT 'x' AS "column", (count(*) - count(x))::BIGINT AS missing_count FROM sig""")
def missing_counts_query(spark, sf_dir):
    """Columns that have missing cells."""
    return missing_counts(signal(spark, sf_dir))


@query("date_like_columns", """
SELECT 'ts' AS "column", count(*)::BIGINT AS parsed FROM events
UNION ALL SELECT 'ts_text', count(ts)::BIGINT FROM events""")
def date_like_columns_query(spark, sf_dir):
    """Typed dates and text that parses as dates; other text is left out."""
    ev = table(spark, sf_dir, "events")
    return date_like_columns(ev.select("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts_text"), "event_type", "props"))


@query("flag_missing_rows", f"WITH {SIGNAL_SQL} SELECT event_id, x IS NULL AS has_missing FROM sig")
def flag_missing_rows_query(spark, sf_dir):
    """Rows with any missing cell."""
    return flag_missing_rows(signal(spark, sf_dir)).select("event_id", "has_missing")


@query("drop_missing_rows", f"WITH {SIGNAL_SQL} SELECT event_id, user_id, event_type, round(x, 6) AS x FROM sig WHERE x IS NOT NULL")
def drop_missing_rows_query(spark, sf_dir):
    """Complete rows only."""
    return rounded(drop_missing_rows(signal(spark, sf_dir)).select("event_id", "user_id", "event_type", "x"), ["x"])


@query("flag_duplicate_rows", f"""WITH {SIGNAL_SQL}
SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type, x) > 1 AS is_duplicate FROM sig""")
def flag_duplicate_rows_query(spark, sf_dir):
    """Every copy of a repeated row is marked, NULL equal to NULL."""
    return flag_duplicate_rows(signal(spark, sf_dir), ["user_id", "event_type", "x"]).select("event_id", "is_duplicate")


@query("remove_duplicate_rows", """
SELECT l_returnflag, l_linestatus, l_quantity, l_discount, l_tax, l_suppkey FROM lineitem
GROUP BY ALL HAVING count(*) = 1""")
def remove_duplicate_rows_query(spark, sf_dir):
    """No copy of a repeated row survives."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax", "l_suppkey")
    return remove_duplicate_rows(li)


@query("remove_duplicate_rows_keep_first", """
SELECT min(l_orderkey) AS l_orderkey, l_returnflag, l_linestatus, l_suppkey FROM lineitem GROUP BY l_returnflag, l_linestatus, l_suppkey""")
def remove_duplicate_rows_keep_first(spark, sf_dir):
    """The first copy of each repeated row survives (B11, keep first)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_suppkey")
    return remove_duplicate_rows(li, ["l_returnflag", "l_linestatus", "l_suppkey"], "first", ["l_orderkey"])


@query("quality_issues", f"""WITH {SIGNAL_SQL}, q AS (SELECT event_id, user_id, event_type, x,
  count(*) OVER (PARTITION BY user_id, event_type, x) > 1 AS d FROM sig)
SELECT event_id AS original_index, CASE WHEN x IS NULL AND d THEN 'Missing & Duplicate' WHEN x IS NULL THEN 'Missing' ELSE 'Duplicate' END AS issue,
  user_id, event_type, round(x, 6) AS x FROM q WHERE x IS NULL OR d""")
def quality_issues_query(spark, sf_dir):
    """What is wrong with which row."""
    return rounded(quality_issues(signal(spark, sf_dir).select("event_id", "user_id", "event_type", "x"), "event_id"), ["x"])


@query("remove_listed_rows", f"WITH {SIGNAL_SQL} SELECT event_id, user_id, round(y, 6) AS y FROM sig WHERE event_id NOT IN (SELECT event_id FROM sig WHERE x IS NULL)")
def remove_listed_rows(spark, sf_dir):
    """Rows of the issue list are dropped by id."""
    sig = signal(spark, sf_dir).select("event_id", "user_id", "x", "y")
    issues = quality_issues(sig, "event_id", ["x", "user_id"]).filter("issue like 'Missing%'")
    return rounded(remove_rows(sig, "event_id", issues.select("original_index")).select("event_id", "user_id", "y"), ["y"])


@query("labeled_partition", """
SELECT d.doc_id, l.quality IS NOT NULL AS labeled, l.quality::INTEGER AS quality FROM documents d LEFT JOIN labels l USING (doc_id)""")
def labeled_partition(spark, sf_dir):
    """Known and unknown labels split and put back together."""
    docs = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    known, unknown = split_labeled(docs, "quality")
    both = known.withColumn("labeled", F.lit(True)).unionByName(unknown.withColumn("labeled", F.lit(False)))
    return both.select("doc_id", "labeled", "quality")


@query("flatten_matrix", """
SELECT vec_id, label, """ + ", ".join(f"round(embedding[{i + 1}]::DOUBLE, 6) + 0.0::DOUBLE AS e_{i}" for i in range(64)) + " FROM embeddings")
def flatten_matrix_query(spark, sf_dir):
    """Vector column to one column per component (A5)."""
    out = flatten_matrix(table(spark, sf_dir, "embeddings"), "embedding", "e", 64)
    return rounded(out, [f"e_{i}" for i in range(64)])
