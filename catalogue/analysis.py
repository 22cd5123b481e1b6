"""Correlation, components, information, rankings, metrics, curves and chart tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.common import SIGNAL_SQL, query, rnd, rounded, signal, table
from tidemark.operators import analysis as an
from tidemark.operators import charts as ch
from tidemark.operators import evaluate as ev
from tidemark.operators.prepare import align_columns, fit_preparation

LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _pairs_sql(cols, source, prefix=""):
    return " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 4) + 0.0::DOUBLE AS corr FROM {source}" for a in cols for b in cols)


@query("correlation_pairs", f"WITH {SIGNAL_SQL}, s AS (SELECT x, y, user_id::DOUBLE AS user_id, CASE WHEN event_type <> 'view' THEN event_id::DOUBLE END AS e FROM sig) "
       + _pairs_sql(["x", "y", "user_id", "e"], "s"))
def correlation_pairs(spark, sf_dir):
    """Pairwise-complete Pearson correlation."""
    s = signal(spark, sf_dir).select("x", "y", "user_id", F.when(F.col("event_type") != "view", F.col("event_id")).alias("e"))
    return rounded(an.correlation_pairs(s), ["corr"], 4)


@query("correlation_matrix", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature, " + ", ".join(f"round(corr({a}, {b}), 4) + 0.0::DOUBLE AS {b}" for b in LI) + " FROM lineitem" for a in LI) + ")")
def correlation_matrix(spark, sf_dir):
    """Square numeric correlation matrix."""
    return rounded(an.correlation_matrix(table(spark, sf_dir, "lineitem"), LI), LI, 4)


@query("correlation_matrix_wide", """
WITH e AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT 'e_' || a.i AS feature_a, 'e_' || b.i AS feature_b, round(corr(a.v, b.v), 4) + 0.0::DOUBLE AS corr FROM e a JOIN e b USING (vec_id) GROUP BY a.i, b.i""")
def correlation_matrix_wide(spark, sf_dir):
    """Sixty-four columns: cross products summed per partition."""
    from tidemark.sources.tables import flatten_matrix

    flat = flatten_matrix(table(spark, sf_dir, "embeddings"), "embedding", "e", 64)
    return rounded(an.correlation_pairs(flat, [f"e_{i}" for i in range(64)]), ["corr"], 4)


@query("correlation_heatmap", """
SELECT 'l_tax' AS feature, 1.0::DOUBLE AS l_tax, 0.0::DOUBLE AS flat UNION ALL SELECT 'flat', 0.0, 0.0""")
def correlation_heatmap(spark, sf_dir):
    """Undefined correlations of a constant are drawn as 0."""
    li = table(spark, sf_dir, "lineitem").select("l_tax", F.lit(3.0).alias("flat"))
    return an.correlation_matrix(li, ["l_tax", "flat"], undefined=0.0)


_DUMMIES = """
WITH r AS (SELECT row_number() OVER () AS i, o_orderstatus AS a, o_orderpriority AS b FROM orders),
c AS (SELECT DISTINCT 'o_orderstatus_' || a AS n FROM r WHERE a IS NOT NULL UNION SELECT DISTINCT 'o_orderpriority_' || b FROM r WHERE b IS NOT NULL),
d AS (SELECT i, n, CASE WHEN n = 'o_orderstatus_' || a OR n = 'o_orderpriority_' || b THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM r, c)
SELECT x.n AS feature_a, y.n AS feature_b, round(corr(x.v, y.v), 4) + 0.0::DOUBLE AS corr FROM d x JOIN d y USING (i) GROUP BY x.n, y.n"""


@query("category_correlation", _DUMMIES)
def category_correlation(spark, sf_dir):
    """Correlation of one-hot columns from pair counts."""
    return rounded(an.category_correlation(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"]), ["corr"], 4)


@query("principal_components", """
WITH s AS (SELECT c_custkey, c_mktsegment, c_acctbal AS a, c_nationkey::DOUBLE AS b FROM customer),
z AS (SELECT c_custkey, c_mktsegment, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS a, (b - avg(b) OVER ()) / stddev_pop(b) OVER () AS b FROM s),
r AS (SELECT corr(a, b) AS r FROM z)
SELECT c_custkey, c_mktsegment, round((CASE WHEN r >= 0 THEN a + b ELSE a - b END) / sqrt(2), 6) + 0.0::DOUBLE AS pc1,
  round((CASE WHEN r >= 0 THEN a - b ELSE a + b END) / sqrt(2), 6) + 0.0::DOUBLE AS pc2 FROM z, r""")
def principal_components(spark, sf_dir):
    """Scores of two standardised features; the label is carried, not used (I4)."""
    cust = table(spark, sf_dir, "customer")
    out = an.principal_components(cust, ["c_acctbal", "c_nationkey"], "c_mktsegment", 2, keep=["c_custkey"])["scores"]
    return rounded(out, {"PC1": "pc1", "PC2": "pc2"})


@query("principal_component_ratios", """
WITH r AS (SELECT abs(corr(c_acctbal, c_nationkey)) AS r FROM customer)
SELECT 1::BIGINT AS component, round((1 + r) / 2, 6) AS ratio FROM r UNION ALL SELECT 2, round((1 - r) / 2, 6) FROM r""")
def principal_component_ratios(spark, sf_dir):
    """Explained variance of each component (I4)."""
    out = an.principal_components(table(spark, sf_dir, "customer"), ["c_acctbal", "c_nationkey"])["explained_variance_ratio"]
    return rounded(spark.createDataFrame(list(enumerate(out, 1)), "component long, ratio double"), ["ratio"])


_MI_SQL = """
WITH d AS (SELECT doc_id AS id, quality AS c, n_chars::DOUBLE AS n, length(text)::DOUBLE / (1 + length(text) - length(replace(text, ' ', ''))) AS w
  FROM documents JOIN labels USING (doc_id)),
f AS (SELECT id, c, 'n_chars' AS feature, n AS v FROM d UNION ALL SELECT id, c, 'word_length', w FROM d),
s AS (SELECT feature, stddev_pop(v) AS sd, avg(abs(v)) AS m FROM f GROUP BY feature),
x AS (SELECT id, c, feature, v / sd + (((id % 1073741824) * 2654435761) % 4294967296 / 4294967296.0::DOUBLE - 0.5::DOUBLE) * 1e-10::DOUBLE * greatest(1.0::DOUBLE, m / sd) AS v
  FROM f JOIN s USING (feature)),
p AS (SELECT a.feature, a.id, a.c, a.v, abs(b.v - a.v) AS dist, row_number() OVER (PARTITION BY a.feature, a.id ORDER BY abs(b.v - a.v)) AS rk
  FROM x a JOIN x b ON a.feature = b.feature AND a.c = b.c AND a.id <> b.id),
r AS (SELECT feature, id, c, v, dist AS r FROM p WHERE rk = 3),
m AS (SELECT r.feature, r.id, any_value(r.c) AS c, count(*) AS m FROM r JOIN x ON x.feature = r.feature AND abs(x.v - r.v) < r.r GROUP BY r.feature, r.id),
h AS (SELECT n, -0.57721566490153286::DOUBLE + coalesce(sum(1.0::DOUBLE / (n - 1)) FILTER (n > 1) OVER (ORDER BY n), 0) AS psi FROM (SELECT unnest(range(1, 5000)) AS n)),
nc AS (SELECT feature, c, count(*) AS nc FROM x GROUP BY feature, c),
nn AS (SELECT feature, count(*) AS nn FROM x GROUP BY feature)
SELECT m.feature, round(greatest(0, max(hn.psi) + max(hk.psi) - avg(hc.psi) - avg(hm.psi)), 6) + 0.0::DOUBLE AS mutual_information
FROM m JOIN nc USING (feature, c) JOIN nn USING (feature) JOIN h hn ON hn.n = nn.nn JOIN h hk ON hk.n = 3 JOIN h hc ON hc.n = nc.nc JOIN h hm ON hm.n = m.m
GROUP BY m.feature"""


def _labeled_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    words = 1 + F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
    return docs.select("doc_id", "quality", "toxic", "lang", "source", "n_chars", (F.length("text").cast("double") / words).alias("word_length"))


@query("mutual_information", _MI_SQL)
def mutual_information(spark, sf_dir):
    """Nearest-neighbour mutual information with the class."""
    return rounded(an.mutual_information(_labeled_documents(spark, sf_dir), ["n_chars", "word_length"], "quality", "doc_id"), ["mutual_information"])


@query("top_mutual_information")
def top_mutual_information(spark, sf_dir):
    """Fifteen most informative columns of the event signal."""
    sig = signal(spark, sf_dir).select("event_id", "event_type", "y", "user_id", F.hour("ts").alias("hour"), F.dayofmonth("ts").alias("day"))
    return an.top_scores(an.mutual_information(sig, ["y", "user_id", "hour", "day"], "event_type", "event_id"), 15)


@query("feature_ranking", """
WITH d AS (SELECT quality AS c, n_chars::DOUBLE AS a, toxic::DOUBLE AS b, length(text)::DOUBLE / (1 + length(text) - length(replace(text, ' ', ''))) AS w
  FROM documents JOIN labels USING (doc_id)),
u AS (SELECT c, 'n_chars' AS f, a AS v FROM d UNION ALL SELECT c, 'toxic', b FROM d UNION ALL SELECT c, 'word_length', w FROM d),
g AS (SELECT f, c, count(*) AS n, avg(v) AS m, var_pop(v) * count(*) AS ss FROM u GROUP BY f, c),
t AS (SELECT f, sum(n * m) / sum(n) AS mu, sum(n) AS nt, count(*) AS k FROM g GROUP BY f),
rel AS (SELECT g.f, (sum(g.n * (g.m - t.mu) ** 2) / (max(t.k) - 1)) / (sum(g.ss) / (max(t.nt) - max(t.k))) AS fs FROM g JOIN t USING (f) GROUP BY g.f),
cr AS (SELECT 'n_chars' AS p, 'toxic' AS q, abs(corr(a, b)) AS r FROM d UNION ALL SELECT 'n_chars', 'word_length', abs(corr(a, w)) FROM d UNION ALL SELECT 'toxic', 'word_length', abs(corr(b, w)) FROM d),
c2 AS (SELECT p, q, greatest(r, 0.001) AS r FROM cr UNION ALL SELECT q, p, greatest(r, 0.001) FROM cr),
one AS (SELECT f FROM rel ORDER BY fs DESC LIMIT 1),
two AS (SELECT rel.f FROM rel JOIN c2 ON c2.p = rel.f JOIN one ON c2.q = one.f ORDER BY rel.fs / c2.r DESC LIMIT 1)
SELECT 1::BIGINT AS rank, f AS feature FROM one UNION ALL SELECT 2, f FROM two
UNION ALL SELECT 3, f FROM rel WHERE f NOT IN (SELECT f FROM one UNION SELECT f FROM two)""")
def feature_ranking(spark, sf_dir):
    """Relevant and mutually different features."""
    return an.minimum_redundancy_ranking(_labeled_documents(spark, sf_dir), ["n_chars", "toxic", "word_length"], "quality", 3)


@query("feature_matrix", """
WITH d AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS bal, CASE WHEN c_nationkey < 20 THEN c_mktsegment END AS seg FROM customer),
m AS (SELECT median(bal) AS md FROM d)
SELECT c_custkey, round(coalesce(bal, md), 6) + 0.0::DOUBLE AS bal,
  """ + ", ".join(f"(coalesce(seg, '__missing__') = '{s}')::INTEGER::DOUBLE AS \"seg_{s}\"" for s in ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "__missing__"])
       + """, 0.0::DOUBLE AS "seg_OTHER" FROM d, m""")
def feature_matrix(spark, sf_dir):
    """Filled and one-hot encoded features, aligned to training columns."""
    cust = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("bal"), F.when(F.col("c_nationkey") < 20, F.col("c_mktsegment")).alias("seg"))
    prep = fit_preparation(cust, ["bal", "seg"], "median")
    out = align_columns(prep.apply(cust, ["c_custkey"]), [*prep.columns, "seg_OTHER"], ["c_custkey"])
    return rounded(out, [n for n in out.columns if n != "c_custkey"])


def _scored(spark, sf_dir):
    """Line items with a made-up score of being returned, taken from their own columns."""
    li = table(spark, sf_dir, "lineitem")
    score = F.col("l_tax") * 5 + F.col("l_quantity") / 100
    returned = F.when(F.col("l_returnflag") == "R", "R").otherwise("A")
    return li.select(returned.alias("l_returnflag"), "l_linestatus", (F.round(score, 2) / 0.95).alias("score"), F.when(F.col("l_quantity") > 25, "A").otherwise("R").alias("guess"))


_SCORED = """
s AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'R' ELSE 'A' END AS l_returnflag, l_linestatus, round(l_tax * 5 + l_quantity / 100, 2) / 0.95::DOUBLE AS score, CASE WHEN l_quantity > 25 THEN 'A' ELSE 'R' END AS guess
  FROM lineitem)"""


@query("classification_metrics", f"""
WITH {_SCORED}, k AS (SELECT l_returnflag AS k FROM s UNION SELECT guess FROM s),
m AS (SELECT k, (SELECT count(*) FROM s WHERE l_returnflag = k AND guess = k)::DOUBLE AS tp, (SELECT count(*) FROM s WHERE l_returnflag = k)::DOUBLE AS sup,
  (SELECT count(*) FROM s WHERE guess = k)::DOUBLE AS said FROM k)
SELECT round(sum(tp) / sum(sup), 8) AS accuracy, round(sum(CASE WHEN said > 0 THEN tp / said ELSE 0 END * sup) / sum(sup), 8) AS precision,
  round(sum(CASE WHEN sup > 0 THEN tp / sup ELSE 0 END * sup) / sum(sup), 8) AS recall, round(sum(2 * tp / (said + sup) * sup) / sum(sup), 8) AS f1 FROM m""")
def classification_metrics(spark, sf_dir):
    """Weighted metrics of a two-class guess (M1)."""
    return rounded(ev.classification_metrics(_scored(spark, sf_dir), "l_returnflag", "guess"), ["accuracy", "precision", "recall", "f1"], 8)


@query("confusion_matrix", """
WITH s AS (SELECT l_returnflag AS a, CASE WHEN l_quantity > 25 THEN 'A' ELSE 'R' END AS p FROM lineitem), k AS (SELECT a AS k FROM s UNION SELECT p FROM s)
SELECT x.k AS actual, y.k AS predicted, (SELECT count(*) FROM s WHERE s.a = x.k AND s.p = y.k)::BIGINT AS count FROM k x, k y""")
def confusion_matrix(spark, sf_dir):
    """Every pair of classes, zeros included (M2)."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", F.when(F.col("l_quantity") > 25, "A").otherwise("R").alias("guess"))
    return ev.confusion_matrix(li, "l_returnflag", "guess")


_CURVE = f"""
WITH {_SCORED}, g AS (SELECT score, count(*) FILTER (l_returnflag = 'R') AS pos, count(*) FILTER (l_returnflag <> 'R') AS neg FROM s GROUP BY score),
r AS (SELECT score, pos, neg, sum(pos) OVER o AS cp, sum(neg) OVER o AS cn, sum(pos) OVER () AS ap, sum(neg) OVER () AS an FROM g WINDOW o AS (ORDER BY score DESC))"""


@query("roc_curve", _CURVE + """ SELECT round(score, 6) AS threshold, round(cn::DOUBLE / an, 8) AS fpr, round(cp::DOUBLE / ap, 8) AS tpr FROM r
UNION ALL SELECT NULL, 0.0, 0.0""")
def roc_curve(spark, sf_dir):
    """Receiver operating curve (M7, M8)."""
    binary, _ = ev.clean_binary(_scored(spark, sf_dir), "l_returnflag", "score")
    out = ev.roc_curve(binary)
    out = out.withColumn("threshold", rnd(F.when(F.col("threshold") != float("inf"), F.col("threshold"))))
    return rounded(out, ["fpr", "tpr"], 8)


@query("precision_recall_curve", _CURVE + """ SELECT round(score, 6) AS threshold, round(cp::DOUBLE / ap, 8) AS recall, round(cp::DOUBLE / (cp + cn), 8) AS precision FROM r
UNION ALL SELECT NULL, 0.0, 1.0""")
def precision_recall_curve(spark, sf_dir):
    """Precision over recall (M9)."""
    binary, _ = ev.clean_binary(_scored(spark, sf_dir), "l_returnflag", "score")
    return rounded(ev.precision_recall_curve(binary).withColumn("threshold", rnd("threshold")), ["recall", "precision"], 8)


@query("curve_areas", _CURVE + """
SELECT round(sum(neg::DOUBLE / an * (2 * cp - pos) / ap / 2), 8) AS roc_auc,
  round(sum(pos::DOUBLE / ap * (cp::DOUBLE / (cp + cn) + CASE WHEN cp + cn = pos + neg THEN 1.0 ELSE (cp - pos)::DOUBLE / (cp + cn - pos - neg) END) / 2), 8) AS pr_auc FROM r""")
def curve_areas(spark, sf_dir):
    """Trapezoid areas under both curves (M8, M9)."""
    binary, _ = ev.clean_binary(_scored(spark, sf_dir), "l_returnflag", "score")
    both = ev.roc_auc(binary).select(rnd("auc", 8).alias("roc_auc"))
    return both.join(ev.precision_recall_auc(binary).select(rnd("auc", 8).alias("pr_auc")), F.lit(True), "inner")


@query("calibration_curve", f"""
WITH {_SCORED}, b AS (SELECT (SELECT count(*) FROM range(1, 10) t(i) WHERE i * 0.1::DOUBLE < s.score) AS bin, score, (l_returnflag = 'R')::INTEGER AS y FROM s)
SELECT bin::BIGINT AS bin, round(avg(score), 6) AS mean_predicted, round(avg(y), 8) AS fraction_positive, count(*)::BIGINT AS count FROM b GROUP BY bin""")
def calibration_curve(spark, sf_dir):
    """Observed share of positives per score bin."""
    binary, _ = ev.clean_binary(_scored(spark, sf_dir), "l_returnflag", "score")
    return rounded(ev.calibration_curve(binary).withColumn("fraction_positive", rnd("fraction_positive", 8)), ["mean_predicted"])


@query("cluster_shares", """
WITH c AS (SELECT CASE WHEN l_returnflag = 'N' THEN -1 ELSE l_linenumber END AS cluster FROM lineitem)
SELECT cluster::INTEGER AS cluster, count(*)::BIGINT AS count, CASE WHEN cluster = -1 THEN 'Noise' ELSE 'Cluster ' || cluster END AS description,
  round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS percentage FROM c GROUP BY cluster""")
def cluster_shares(spark, sf_dir):
    """Cluster sizes, descriptions and shares."""
    li = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") == "N", -1).otherwise(F.col("l_linenumber")).alias("cluster"))
    both = ev.cluster_summary(li).join(ev.cluster_shares(li).select("cluster", "percentage"), "cluster")
    return rounded(both, ["percentage"])


@query("label_source_shares", """
WITH s AS (SELECT CASE event_type WHEN 'click' THEN 'Original' WHEN 'view' THEN 'Original' WHEN 'error' THEN 'Remaining unlabeled' ELSE 'Pseudo-labeled' END AS source FROM events)
SELECT source, count(*)::BIGINT AS count, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS percentage FROM s GROUP BY source""")
def label_source_shares(spark, sf_dir):
    """Share of each label source."""
    e = F.col("event_type")
    src = F.when(e.isin("click", "view"), "original").when(e == "error", "remaining_unlabeled").otherwise("pseudo_labeled")
    return rounded(ev.label_source_shares(table(spark, sf_dir, "events").select(src.alias("label_source")), "label_source"), ["percentage"])


def _bins_sql(col, source, bins):
    return f"""
  SELECT '{col}' AS "column", i AS bin, lo + i * (hi - lo) / {bins} AS "left", lo + (i + 1) * (hi - lo) / {bins} AS "right",
    (SELECT count(*) FROM {source} WHERE {col} >= lo + i * ((hi - lo) / {bins}) AND ({col} < lo + (i + 1) * ((hi - lo) / {bins}) OR i = {bins - 1})) AS n,
    (SELECT count({col}) FROM {source}) AS total, (hi - lo) / {bins} AS w
  FROM (SELECT min({col})::DOUBLE AS lo, max({col})::DOUBLE AS hi FROM {source}), range(0, {bins}) t(i)"""


@query("histogram", f"""WITH {SIGNAL_SQL}, h AS ({_bins_sql('x', 'sig', 24)})
SELECT bin::BIGINT AS bin, round("left", 6) + 0.0::DOUBLE AS "left", round("right", 6) + 0.0::DOUBLE AS "right", n::BIGINT AS count FROM h""")
def histogram(spark, sf_dir):
    """Twenty-four equal-width bins, the last one closed."""
    return rounded(ch.histogram(signal(spark, sf_dir), "x"), ["left", "right"])


@query("centre_lines", f"WITH {SIGNAL_SQL} SELECT round(avg(x), 6) AS mean, round(median(x), 6) AS median FROM sig")
def centre_lines(spark, sf_dir):
    """Mean and median marks."""
    return rounded(ch.centre_lines(signal(spark, sf_dir), "x"), ["mean", "median"])


@query("distribution_comparison", "WITH h AS (" + " UNION ALL ".join(_bins_sql(n, "lineitem", 30) for n in LI) + """)
SELECT "column", bin::BIGINT AS bin, round("left", 6) + 0.0::DOUBLE AS "left", round("right", 6) + 0.0::DOUBLE AS "right", round(n / (total * w), 8) AS density FROM h""")
def distribution_comparison(spark, sf_dir):
    """Thirty-bin densities of several columns in one pass."""
    out = ch.distribution_comparison(table(spark, sf_dir, "lineitem"), LI)
    return rounded(out.withColumn("density", rnd("density", 8)), ["left", "right"])


@query("scatter_points", f"""WITH {SIGNAL_SQL} SELECT round(x, 6) + 0.0::DOUBLE AS x, round(y, 6) + 0.0::DOUBLE AS y, user_id, event_type,
  (dense_rank() OVER (ORDER BY event_type) - 1)::INTEGER AS code FROM sig WHERE x IS NOT NULL""")
def scatter_points(spark, sf_dir):
    """Complete 3-D points with class codes."""
    return rounded(ch.scatter_points(signal(spark, sf_dir), ["x", "y", "user_id"], "event_type"), ["x", "y"])


@query("class_separation", """SELECT l_quantity, l_tax, l_linenumber, (dense_rank() OVER (ORDER BY l_linenumber) - 1)::INTEGER AS code FROM lineitem""")
def class_separation(spark, sf_dir):
    """Points coloured per class."""
    return ch.class_separation(table(spark, sf_dir, "lineitem"), "l_quantity", "l_tax", "l_linenumber")


@query("line_points", f"""WITH {SIGNAL_SQL} SELECT event_id AS row_index, date_trunc('second', ts)::VARCHAR AS x, round(x, 6) + 0.0::DOUBLE AS y FROM sig
WHERE x IS NOT NULL""")
def line_points(spark, sf_dir):
    """Complete rows with date text on the x axis."""
    s = signal(spark, sf_dir).withColumn("when", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    out = ch.line_points(s, "when", "x", "event_id")
    return rounded(out.withColumn("x", F.date_format("x", "yyyy-MM-dd HH:mm:ss")), ["y"])


@query("time_series", f"""WITH {SIGNAL_SQL}, f AS (SELECT * FROM sig)
SELECT event_id AS row_index, 'x' AS signal, round(x, 6) + 0.0::DOUBLE AS value FROM f UNION ALL SELECT event_id, 'y', round(y, 6) FROM f""")
def time_series(spark, sf_dir):
    """Long form of several signals."""
    return rounded(ch.time_series(signal(spark, sf_dir), "event_id", ["x", "y"]), ["value"])


_BOX = """
q AS (SELECT g, quantile_cont(v, 0.25) AS q1, median(v) AS md, quantile_cont(v, 0.75) AS q3 FROM s GROUP BY g),
b AS (SELECT g, count(*) AS n, any_value(q1) AS q1, any_value(md) AS md, any_value(q3) AS q3, min(v) FILTER (v >= q1 - 1.5 * (q3 - q1)) AS wl,
  max(v) FILTER (v <= q3 + 1.5 * (q3 - q1)) AS wh, avg(v) AS mean, min(v) AS mn, max(v) AS mx FROM s JOIN q USING (g) GROUP BY g)
SELECT g AS "group", n::BIGINT AS count, round(q1, 6) + 0.0::DOUBLE AS q1, round(md, 6) + 0.0::DOUBLE AS median, round(q3, 6) + 0.0::DOUBLE AS q3,
  round(wl, 6) + 0.0::DOUBLE AS whisker_low, round(wh, 6) + 0.0::DOUBLE AS whisker_high, round(mean, 4) + 0.0::DOUBLE AS mean, round(mn, 6) + 0.0::DOUBLE AS min, round(mx, 6) + 0.0::DOUBLE AS max,
  (SELECT count(*) FROM s WHERE s.g = b.g AND (v < wl OR v > wh))::BIGINT AS outliers FROM b"""


@query("box_statistics", f"WITH {SIGNAL_SQL}, s AS (SELECT event_type AS g, x AS v FROM sig WHERE x IS NOT NULL), {_BOX}")
def box_statistics(spark, sf_dir):
    """Quartiles, whiskers and outliers per category."""
    out = ch.box_statistics(signal(spark, sf_dir), "x", "event_type").withColumn("mean", rnd("mean", 4))
    return rounded(out, ["q1", "median", "q3", "whisker_low", "whisker_high", "min", "max"])


@query("grouped_box_statistics", f"""WITH t AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 12),
s AS (SELECT p_brand AS g, p_retailprice AS v FROM part WHERE p_brand IN (SELECT p_brand FROM t)), {_BOX}""")
def grouped_box_statistics(spark, sf_dir):
    """Box statistics of the twelve largest groups."""
    out = ch.grouped_box_statistics(table(spark, sf_dir, "part"), "p_brand", "p_retailprice").withColumn("mean", rnd("mean", 4))
    return rounded(out, ["q1", "median", "q3", "whisker_low", "whisker_high", "min", "max"])


@query("box_outliers", f"""WITH {SIGNAL_SQL}, q AS (SELECT quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM sig)
SELECT 'all' AS "group", round(y, 6) AS value FROM sig, q WHERE y < q1 - 1.5 * (q3 - q1) OR y > q3 + 1.5 * (q3 - q1)""")
def box_outliers(spark, sf_dir):
    """Values beyond the whiskers."""
    return rounded(ch.box_outliers(signal(spark, sf_dir), "y"), ["value"])


@query("bar_means", """SELECT user_id::VARCHAR AS category, round(avg(value), 4) AS value FROM events GROUP BY user_id ORDER BY avg(value) DESC, user_id::VARCHAR LIMIT 20""")
def bar_means(spark, sf_dir):
    """Highest means by category."""
    return rounded(ch.bar_chart(table(spark, sf_dir, "events"), "user_id", "value"), ["value"], 4)


@query("bar_counts", """SELECT coalesce(CASE WHEN p_size > 5 THEN p_brand END, 'Missing') AS category, count(*)::DOUBLE AS value FROM part
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def bar_counts(spark, sf_dir):
    """Most frequent categories, missing ones as a category."""
    part = table(spark, sf_dir, "part").select(F.when(F.col("p_size") > 5, F.col("p_brand")).alias("brand"))
    return ch.bar_chart(part, "brand")


@query("missing_bars", f"""WITH {SIGNAL_SQL}, s AS (SELECT count(*) - count(x) AS a, count(*) FILTER (event_type = 'view') AS b FROM sig)
SELECT 'x' AS "column", a::BIGINT AS missing_count FROM s UNION ALL SELECT 'kind', b::BIGINT FROM s""")
def missing_bars(spark, sf_dir):
    """Columns with missing cells, fewest first."""
    s = signal(spark, sf_dir).select("x", "y", F.when(F.col("event_type") != "view", F.col("event_type")).alias("kind"))
    return ch.missing_bars(s)
