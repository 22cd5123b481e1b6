"""Splits, classifiers, neighbours, clustering, self-training, curves and storage."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalogue.analysis import _labeled_documents
from catalogue.common import SIGNAL_SQL, query, rnd, rounded, signal, table
from tidemark.operators import cluster as cl
from tidemark.operators import curves as cu
from tidemark.operators import models as mo
from tidemark.operators import selftrain as st
from tidemark.operators.dbscan import dbscan
from tidemark.operators.evaluate import comparison_table, metric_list
from tidemark.operators.neighbours import k_distances, knn_classify
from tidemark.operators.prepare import fit_preparation, vector_from_array
from tidemark.operators.recipe import Dataset
from tidemark.plans.session import scratch_folder
from tidemark.sources import project as pr
from tidemark.sources.tables import read_csv, write_table

DBSCAN_EPS, DBSCAN_MIN = 1.14, 4


def _points(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("x"))


def _numeric_documents(spark, sf_dir):
    return _labeled_documents(spark, sf_dir).select("doc_id", "quality", "n_chars", "word_length", "toxic")


def _hash(seed, column):
    return f"md5('{seed}:' || {column}) || ':' || {column}"


@query("train_test_split", f"""SELECT event_id, row_number() OVER (ORDER BY {_hash(42, 'event_id')}) <= ceil(count(*) OVER () * 0.3::DOUBLE) AS test FROM events""")
def train_test_split(spark, sf_dir):
    """Exact share of test rows by seeded hash rank."""
    train, test = mo.train_test_split(table(spark, sf_dir, "events").select("event_id"), "event_id")
    return train.withColumn("test", F.lit(False)).unionByName(test.withColumn("test", F.lit(True)))


@query("train_test_split_stratified", f"""
WITH n AS (SELECT event_type, count(*) AS n, (SELECT count(*) FROM events) AS t FROM events GROUP BY 1),
w AS (SELECT event_type, n * ceil(t * 0.3::DOUBLE) / t AS e, floor(n * ceil(t * 0.3::DOUBLE) / t) AS f, ceil(t * 0.3::DOUBLE) AS want FROM n),
m AS (SELECT event_type, f + CASE WHEN row_number() OVER (ORDER BY e - f DESC, event_type) <= want - sum(f) OVER () THEN 1 ELSE 0 END AS m FROM w)
SELECT event_id, e.event_type, row_number() OVER (PARTITION BY e.event_type ORDER BY {_hash(42, 'event_id')}) <= m AS test FROM events e JOIN m USING (event_type)""")
def train_test_split_stratified(spark, sf_dir):
    """The same split spread over the classes."""
    ev = table(spark, sf_dir, "events").select("event_id", "event_type")
    train, test = mo.train_test_split(ev, "event_id", label="event_type")
    return train.withColumn("test", F.lit(False)).unionByName(test.withColumn("test", F.lit(True)))


_KNN = f"""
p AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS x, row_number() OVER (ORDER BY {_hash(42, 'vec_id')}) <= ceil(count(*) OVER () * 0.3::DOUBLE) AS test FROM embeddings),
d AS (SELECT q.id AS qid, t.id, t.label, q.label AS truth, DIST AS dist, row_number() OVER (PARTITION BY q.id ORDER BY DIST, t.id) AS rk FROM p q JOIN p t ON q.test AND NOT t.test)"""
_EUCLID = "list_distance(q.x, t.x)"
_MANHATTAN = "list_sum(list_transform(list_zip(q.x, t.x), lambda z: abs(z[1] - z[2])))"


@query("knn_classify", "WITH " + _KNN.replace("DIST", _EUCLID) + """, v AS (SELECT qid, label, count(*) AS w FROM d WHERE rk <= 5 GROUP BY qid, label)
SELECT qid, arg_min(label, (-w, label))::BIGINT AS prediction, round(max(w) / sum(w)::DOUBLE, 6) AS confidence FROM v GROUP BY qid""")
def knn_classify_query(spark, sf_dir):
    """Five nearest neighbours, one vote each."""
    train, test = mo.train_test_split(_points(spark, sf_dir), "id")
    return rounded(knn_classify(train, test, "label", 5, query_id="id"), ["confidence"])


@query("knn_classify_weighted", "WITH " + _KNN.replace("DIST", _MANHATTAN) + """, v AS (SELECT qid, label, sum(1 / dist) AS w FROM d WHERE rk <= 7 GROUP BY qid, label)
SELECT qid, arg_max(label, w)::BIGINT AS prediction, round(max(w) / sum(w), 6) AS confidence FROM v GROUP BY qid""")
def knn_classify_weighted(spark, sf_dir):
    """Seven neighbours by city-block distance, votes 1/d."""
    train, test = mo.train_test_split(_points(spark, sf_dir), "id")
    return rounded(knn_classify(train, test, "label", 7, "distance", 1, query_id="id"), ["confidence"])


@query("k_distances", """
WITH d AS (SELECT a.vec_id AS id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS rk
  FROM embeddings a, embeddings b)
SELECT id, round(d, 6) AS k_distance FROM d WHERE rk = 5""")
def k_distances_query(spark, sf_dir):
    """Distance to the fifth neighbour, the point itself counted."""
    return rounded(k_distances(_points(spark, sf_dir)), ["k_distance"])


@query("accuracy_over_k", f"""
WITH p AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS x, row_number() OVER (PARTITION BY label ORDER BY {_hash(42, 'vec_id')}) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
f AS (SELECT id, label, x, CASE WHEN r <= n // 3 THEN 0 WHEN r <= (n * 2) // 3 THEN 1 ELSE 2 END AS fold FROM p),
d AS (SELECT q.fold, q.id AS qid, q.label AS truth, t.label, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.x, t.x), t.id) AS rk FROM f q JOIN f t ON q.fold <> t.fold),
k AS (SELECT unnest(range(1, least(20, greatest(3, (SELECT count(*) FROM embeddings) // 5)) + 1)) AS k),
v AS (SELECT k, fold, qid, any_value(truth) AS truth, label, count(*) AS w FROM d JOIN k ON rk <= k GROUP BY k, fold, qid, label),
s AS (SELECT k, fold, qid, arg_min(label, (-w, label)) = any_value(truth) AS ok FROM v GROUP BY k, fold, qid),
a AS (SELECT k, fold, avg(ok::INTEGER) AS acc FROM s GROUP BY k, fold)
SELECT k::INTEGER AS k, round(avg(acc), 8) AS accuracy FROM a GROUP BY k""")
def accuracy_over_k(spark, sf_dir):
    """Cross-validated accuracy for each number of neighbours."""
    return rounded(cu.accuracy_over_k(_points(spark, sf_dir), "label"), ["accuracy"], 8)


@query("dbscan", f"""
WITH RECURSIVE e AS (SELECT a.vec_id AS u, b.vec_id AS v FROM embeddings a, embeddings b WHERE list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) <= {DBSCAN_EPS}),
c AS (SELECT u FROM e GROUP BY u HAVING count(*) >= {DBSCAN_MIN}),
ce AS (SELECT e.u, e.v FROM e JOIN c a ON a.u = e.u JOIN c b ON b.u = e.v),
r AS (SELECT u, u AS root FROM c UNION SELECT ce.v AS u, r.root FROM r JOIN ce ON ce.u = r.u),
m AS (SELECT u, min(root) AS root FROM r GROUP BY u),
k AS (SELECT u, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM m),
b AS (SELECT e.u, min(k.cluster) AS cluster FROM e JOIN k ON k.u = e.v WHERE e.u NOT IN (SELECT u FROM c) GROUP BY e.u)
SELECT vec_id AS id, coalesce(k.cluster, b.cluster, -1)::BIGINT AS cluster, k.cluster IS NOT NULL AS core FROM embeddings
LEFT JOIN k ON k.u = vec_id LEFT JOIN b ON b.u = vec_id""")
def dbscan_query(spark, sf_dir):
    """Density clusters of all embeddings (K3)."""
    return dbscan(_points(spark, sf_dir), DBSCAN_EPS, DBSCAN_MIN)


@query("dbscan_copies", """
WITH RECURSIVE w AS (SELECT l_quantity AS a, round(l_tax * 100) AS b, count(*) AS n FROM lineitem GROUP BY 1, 2),
e AS (SELECT x.a, x.b, y.a AS c, y.b AS d, y.n FROM w x JOIN w y ON (x.a - y.a) ** 2 + (x.b - y.b) ** 2 <= 1.44),
k AS (SELECT a, b FROM e GROUP BY a, b HAVING sum(n) >= 670),
ke AS (SELECT e.a, e.b, e.c, e.d FROM e JOIN k x ON x.a = e.a AND x.b = e.b JOIN k y ON y.a = e.c AND y.b = e.d),
r AS (SELECT a, b, a AS ra, b AS rb FROM k UNION SELECT ke.c, ke.d, r.ra, r.rb FROM r JOIN ke ON ke.a = r.a AND ke.b = r.b),
m AS (SELECT a, b, min((ra, rb)) AS root FROM r GROUP BY a, b)
SELECT (SELECT count(DISTINCT root) FROM m)::BIGINT AS clusters, (SELECT sum(n) FROM w JOIN k USING (a, b))::BIGINT AS core_rows,
  (SELECT sum(n) FROM w WHERE NOT EXISTS (SELECT 1 FROM e JOIN k ON k.a = e.c AND k.b = e.d WHERE e.a = w.a AND e.b = w.b))::BIGINT AS noise_rows""")
def dbscan_copies(spark, sf_dir):
    """A large table with many copies of each point (K3)."""
    li = table(spark, sf_dir, "lineitem")
    pts = li.select(
        F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate").alias("id"),
        F.array("l_quantity", F.round(F.col("l_tax") * 100)).alias("x"))
    out = dbscan(pts, 1.2, 670)
    return out.agg(
        F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("clusters"), F.count_if(F.col("core")).alias("core_rows"),
        F.count_if(F.col("cluster") == -1).alias("noise_rows"))


@query("cluster_metrics", """
WITH p AS (SELECT vec_id AS id, label AS k, embedding::DOUBLE[] AS x FROM embeddings),
s AS (SELECT k, count(*) AS n FROM p GROUP BY k),
d AS (SELECT a.id, a.k, b.k AS o, sum(list_distance(a.x, b.x)) AS t FROM p a, p b GROUP BY a.id, a.k, b.k),
i AS (SELECT d.id, max(CASE WHEN d.k = d.o THEN t / (n - 1) END) AS a, min(CASE WHEN d.k <> d.o THEN t / n END) AS b FROM d JOIN s ON s.k = d.o GROUP BY d.id),
e AS (SELECT id, k, unnest(range(0, 64)) AS j, unnest(x) AS v FROM p),
c AS (SELECT k, j, avg(v) AS m FROM e GROUP BY k, j), g AS (SELECT j, avg(v) AS m FROM e GROUP BY j),
q AS (SELECT e.id, e.k, sum((e.v - c.m) ** 2) AS sq FROM e JOIN c USING (k, j) GROUP BY e.id, e.k),
sp AS (SELECT k, avg(sqrt(sq)) AS sd FROM q GROUP BY k),
cd AS (SELECT a.k AS a, b.k AS b, sqrt(sum((a.m - b.m) ** 2)) AS d FROM c a JOIN c b USING (j) WHERE a.k <> b.k GROUP BY a.k, b.k),
db AS (SELECT avg(r) AS db FROM (SELECT cd.a, max((x.sd + y.sd) / cd.d) AS r FROM cd JOIN sp x ON x.k = cd.a JOIN sp y ON y.k = cd.b GROUP BY cd.a)),
bt AS (SELECT sum(s.n * (c.m - g.m) ** 2) AS b FROM c JOIN g USING (j) JOIN s USING (k)),
wt AS (SELECT sum(sq) AS w FROM q)
SELECT round(avg((i.b - i.a) / greatest(i.a, i.b)), 6) + 0.0::DOUBLE AS silhouette_score, round(any_value(db), 6) AS davies_bouldin_score,
  round(any_value(bt.b) * ((SELECT count(*) FROM p) - (SELECT count(*) FROM s)) / (any_value(w) * ((SELECT count(*) FROM s) - 1)), 6) AS calinski_harabasz_score,
  0::BIGINT AS noise_count, (SELECT count(*) FROM s)::BIGINT AS cluster_count FROM i, db, bt, wt""")
def cluster_metrics(spark, sf_dir):
    """Silhouette, Davies-Bouldin and Calinski-Harabasz of the labelled embeddings (M3-M6)."""
    pts = vector_from_array(_points(spark, sf_dir).withColumnRenamed("label", "cluster"), "x")
    m = cl.clustering_metrics(pts, silhouette="exact")
    names = ["silhouette_score", "davies_bouldin_score", "calinski_harabasz_score"]
    row = tuple(float(m[n]) for n in names) + (int(m["noise_count"]), int(m["cluster_count"]))
    out = spark.createDataFrame([row], ", ".join(f"{n} double" for n in names) + ", noise_count long, cluster_count long")
    return rounded(out, names)


@query("cluster_metrics_single", """SELECT 0::BIGINT AS noise_count, 1::BIGINT AS cluster_count, 'Clustering metrics require at least 2 non-noise clusters with enough samples.' AS note FROM embeddings LIMIT 1""")
def cluster_metrics_single(spark, sf_dir):
    """Metrics are undefined for one cluster, with a note (M6)."""
    m = cl.clustering_metrics(vector_from_array(_points(spark, sf_dir).withColumn("cluster", F.lit(0)), "x"))
    return spark.createDataFrame([(m["noise_count"], m["cluster_count"], m["note"])], "noise_count long, cluster_count long, note string")


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("bigint").alias("c_nationkey"), "c_mktsegment")


@query("kmeans_clusters")
def kmeans_clusters(spark, sf_dir):
    """Best of several k-means runs on scaled features (K2, K5)."""
    made = cl.cluster_table(_customers(spark, sf_dir), "kmeans", "c_custkey", ["c_acctbal", "c_nationkey"], {"n_clusters": 4, "n_init": 3}, scatter=False, silhouette="squared")
    return made["clustered"]


@query("kmeans_conservation", "SELECT count(*)::BIGINT AS n_rows, 4::BIGINT AS clusters FROM customer")
def kmeans_conservation(spark, sf_dir):
    """Every row is in one of the requested clusters (K2)."""
    vec = fit_preparation(_customers(spark, sf_dir), ["c_acctbal", "c_nationkey"], scale=True).vectors(_customers(spark, sf_dir), ["c_custkey"])
    out = cl.fit_kmeans(vec, 4, 2).transform(vec)
    return out.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("cluster").alias("clusters"))


@query("hierarchical_clusters")
def hierarchical_clusters(spark, sf_dir):
    """Bottom-up clusters of all embeddings (K4)."""
    return cl.hierarchical(_points(spark, sf_dir), 10, "average")


@query("cluster_scatter", """
WITH z AS (SELECT c_custkey, (c_nationkey % 3)::VARCHAR AS cluster, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER () AS a,
  (c_nationkey - avg(c_nationkey) OVER ()) / stddev_pop(c_nationkey) OVER () AS b FROM customer), r AS (SELECT corr(a, b) AS r FROM z)
SELECT c_custkey, cluster, round((CASE WHEN r >= 0 THEN a + b ELSE a - b END) / sqrt(2), 6) + 0.0::DOUBLE AS pc1,
  round((CASE WHEN r >= 0 THEN a - b ELSE a + b END) / sqrt(2), 6) + 0.0::DOUBLE AS pc2 FROM z, r""")
def cluster_scatter(spark, sf_dir):
    """Two components of the scaled features with the cluster of each row (K6)."""
    cust = _customers(spark, sf_dir)
    labels = cust.select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 3).alias("cluster"))
    return rounded(cl.cluster_scatter(cust, ["c_acctbal", "c_nationkey"], labels, "c_custkey")["points"], {"PC1": "pc1", "PC2": "pc2"})


@query("elbow_curve")
def elbow_curve(spark, sf_dir):
    """Sum of squared distances for a growing number of clusters."""
    vec = fit_preparation(_customers(spark, sf_dir), ["c_acctbal", "c_nationkey"], scale=True).vectors(_customers(spark, sf_dir), ["c_custkey"])
    return cl.elbow_curve(vec, n_init=1)


@query("silhouette_curve")
def silhouette_curve(spark, sf_dir):
    """Silhouette for a growing number of clusters."""
    return cl.silhouette_curve(vector_from_array(_points(spark, sf_dir), "x"), n_init=1, method="squared")


def _balances(spark, sf_dir):
    return _customers(spark, sf_dir).select(F.col("c_custkey").alias("id"), F.array("c_acctbal").alias("x"))


# On a line the spanning tree joins neighbours, so its edges are the gaps between sorted values.
@query("linkage_distances", """
WITH g AS (SELECT c_acctbal::DOUBLE - lag(c_acctbal::DOUBLE) OVER (ORDER BY c_acctbal, c_custkey) AS gap FROM customer)
SELECT row_number() OVER (ORDER BY gap)::BIGINT AS step, round(gap, 6) + 0.0::DOUBLE AS distance FROM g WHERE gap IS NOT NULL""")
def linkage_distances(spark, sf_dir):
    """Single-linkage merge heights of all customers' balances."""
    return rounded(cl.linkage_distances(_balances(spark, sf_dir), linkage="single"), ["distance"])


@query("single_linkage_clusters", """
WITH g AS (SELECT c_custkey, c_acctbal, c_acctbal::DOUBLE - lag(c_acctbal::DOUBLE) OVER (ORDER BY c_acctbal, c_custkey) AS gap FROM customer),
r AS (SELECT *, row_number() OVER (ORDER BY gap DESC NULLS LAST) <= 6 AS cut FROM g),
s AS (SELECT c_custkey, sum(cut::INTEGER) OVER (ORDER BY c_acctbal, c_custkey) AS part FROM r),
f AS (SELECT part, min(c_custkey) AS first FROM s GROUP BY part),
n AS (SELECT part, (row_number() OVER (ORDER BY first) - 1)::BIGINT AS cluster FROM f)
SELECT c_custkey::BIGINT AS id, cluster FROM s JOIN n USING (part)""")
def single_linkage_clusters(spark, sf_dir):
    """Seven single-linkage clusters of all customers' balances (K4)."""
    return cl.hierarchical(_balances(spark, sf_dir), 7, "single")


def _parts(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.col("p_partkey").alias("id"), F.array(F.col("p_size") / 10.0, F.col("p_retailprice") / 100.0).alias("x"))


# Ward's merge costs, height squared over two, add up to the total sum of squares about the mean, whatever the tree.
@query("ward_merge_cost", """
WITH p AS (SELECT p_size / 10.0 AS a, p_retailprice / 100.0 AS b FROM part)
SELECT (count(*) - 1)::BIGINT AS merges, round(sum(power(a - (SELECT avg(a) FROM p), 2) + power(b - (SELECT avg(b) FROM p), 2)), 3) + 0.0::DOUBLE AS total_cost FROM p""")
def ward_merge_cost(spark, sf_dir):
    """Ward's tree of all parts by size and price, checked by the sum of its merge costs."""
    merges = cl.ward_merges(_parts(spark, sf_dir))
    return merges.agg(F.count(F.lit(1)).alias("merges"), F.round(F.sum(F.col("height") * F.col("height") / 2), 3).alias("total_cost"))


@query("ward_clusters")
def ward_clusters(spark, sf_dir):
    """Five Ward clusters of all parts by size and price; tests compare with the sequential algorithm (K4)."""
    return cl.hierarchical(_parts(spark, sf_dir), 5, "ward")


@query("ward_linkage_distances")
def ward_linkage_distances(spark, sf_dir):
    """Ward merge heights of all customers' balances in thousands."""
    customers = _customers(spark, sf_dir).select(F.col("c_custkey").alias("id"), F.array(F.col("c_acctbal") / 1000.0).alias("x"))
    return rounded(cl.linkage_distances(customers, linkage="ward"), ["distance"])


def _workflow(spark, sf_dir, algorithm, parameters=None):
    docs = _labeled_documents(spark, sf_dir).select("doc_id", "quality", "n_chars", "word_length", "toxic", "lang")
    return mo.train_and_evaluate(docs, "quality", "doc_id", algorithm, parameters, stratify=True)


def _metrics_row(spark, made):
    m = made["metrics"]
    return spark.createDataFrame([tuple(float(m[k]) for k in ("accuracy", "precision", "recall", "f1"))], "accuracy double, precision double, recall double, f1 double")


@query("logistic_regression_workflow")
def logistic_regression_workflow(spark, sf_dir):
    """Prepare, split, fit and evaluate a logistic regression on labelled documents."""
    return _metrics_row(spark, _workflow(spark, sf_dir, "logistic_regression"))


@query("decision_tree_workflow")
def decision_tree_workflow(spark, sf_dir):
    """The same with a decision tree."""
    return _metrics_row(spark, _workflow(spark, sf_dir, "decision_tree", {"max_depth": 5}))


@query("random_forest_workflow")
def random_forest_workflow(spark, sf_dir):
    """The same with a random forest."""
    return _metrics_row(spark, _workflow(spark, sf_dir, "random_forest", {"n_estimators": 20, "max_depth": 6}))


@query("kernel_svm_workflow")
def kernel_svm_workflow(spark, sf_dir):
    """The same with a support vector machine on a kernel feature map."""
    return _metrics_row(spark, _workflow(spark, sf_dir, "svm"))


@query("knn_workflow")
def knn_workflow(spark, sf_dir):
    """The same with nearest neighbours."""
    return _metrics_row(spark, _workflow(spark, sf_dir, "knn"))


_SEPARABLE = "CASE WHEN event_type IN ('purchase', 'signup', 'view') THEN 'late' ELSE 'early' END"


def _separable(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    side = F.when(F.col("event_type").isin("purchase", "signup", "view"), "late").otherwise("early")
    return ev.select("event_id", "event_type", side.alias("side"))


@query("workflow_predictions", f"""
WITH r AS (SELECT event_id, {_SEPARABLE} AS side, row_number() OVER (ORDER BY {_hash(42, 'event_id')}) AS r, count(*) OVER () AS n FROM events)
SELECT event_id, side, side AS prediction FROM r WHERE r <= ceil(n * 0.3::DOUBLE)""")
def workflow_predictions(spark, sf_dir):
    """Test-row predictions of a one-hot encoded feature that decides the label."""
    made = mo.train_and_evaluate(_separable(spark, sf_dir), "side", "event_id", "decision_tree")
    return made["predictions"].select("event_id", "side", "prediction")


@query("prediction_columns", f"SELECT event_id, event_type, {_SEPARABLE} AS side, {_SEPARABLE} AS tree_prediction, {_SEPARABLE} AS forest_prediction, {_SEPARABLE} AS logit_prediction FROM events")
def prediction_columns(spark, sf_dir):
    """One prediction column per model beside the table."""
    ev = _separable(spark, sf_dir)
    fitted = [
        mo.fit_classifier(ev, "side", "event_id", "decision_tree", name="tree"),
        mo.fit_classifier(ev, "side", "event_id", "random_forest", {"n_estimators": 5, "max_features": None}, name="forest"),
        mo.fit_classifier(ev, "side", "event_id", "logistic_regression", name="logit"),
    ]
    return mo.prediction_columns(fitted, ev, "event_id")


@query("evaluate_models", "SELECT 'tree' AS name, 1.0::DOUBLE AS accuracy, 1.0::DOUBLE AS f1 FROM events LIMIT 1")
def evaluate_models(spark, sf_dir):
    """A saved model loaded and evaluated on a table."""
    ev = _separable(spark, sf_dir)
    folder = f"{scratch_folder(spark)}/model-{uuid.uuid4().hex}"
    pr.save_model(mo.fit_classifier(ev, "side", "event_id", "decision_tree", name="tree"), folder)
    out = mo.evaluate_models([pr.load_model(spark, folder)], ev, "side", "event_id")
    return spark.createDataFrame([(o["name"], o["metrics"]["accuracy"], o["metrics"]["f1"]) for o in out], "name string, accuracy double, f1 double")


@query("model_queue", """
SELECT name, status FROM (VALUES ('tree', 'trained'), ('broken', 'failed'), ('groups', 'trained')) t(name, status)""")
def model_queue(spark, sf_dir):
    """A queue of models trained side by side; one failure stays its own."""
    specs = [
        {"name": "tree", "category": "supervised", "algorithm": "decision_tree", "parameters": {"max_depth": 3}},
        {"name": "broken", "category": "supervised", "algorithm": "no_such_model"},
        {"name": "groups", "category": "unsupervised", "algorithm": "kmeans", "parameters": {"n_clusters": 3, "n_init": 1}, "options": {"features": ["n_chars", "word_length"], "silhouette": "squared", "scatter": False}},
    ]
    _, status = mo.train_all(_numeric_documents(spark, sf_dir), specs, "quality", "doc_id", 3)
    return status.select("name", "status")


@query("model_comparison")
def model_comparison(spark, sf_dir):
    """Comparison table of a classifier and a clusterer."""
    tree = _workflow(spark, sf_dir, "decision_tree", {"max_depth": 4})
    groups = cl.cluster_table(_numeric_documents(spark, sf_dir), "kmeans", "doc_id", ["n_chars", "word_length"], {"n_clusters": 3, "n_init": 1}, scatter=False)
    records = [
        {"name": "tree", "label": "quality", "category": "supervised", "algorithm": "decision_tree", "metrics": tree["metrics"]},
        {"name": "groups", "category": "unsupervised", "algorithm": "kmeans", "metrics": groups["metrics"]},
    ]
    return comparison_table(spark, records)


@query("metric_list")
def metric_list_query(spark, sf_dir):
    """Finite metrics of a model in long form."""
    tree = _workflow(spark, sf_dir, "decision_tree", {"max_depth": 4})
    return metric_list(spark, [{"name": "tree", "category": "supervised", "metrics": tree["metrics"]}])


@query("feature_importance")
def feature_importance(spark, sf_dir):
    """Fifteen most important features of a forest."""
    model = mo.fit_classifier(_numeric_documents(spark, sf_dir), "quality", "doc_id", "random_forest", {"n_estimators": 20, "max_depth": 6})
    return mo.feature_importance(model)


@query("coefficients")
def coefficients(spark, sf_dir):
    """Mean absolute coefficients of a linear model."""
    model = mo.fit_classifier(_numeric_documents(spark, sf_dir), "quality", "doc_id", "logistic_regression")
    return mo.feature_importance(model)


@query("learning_curve")
def learning_curve(spark, sf_dir):
    """Accuracy for five training sizes over three folds."""
    return cu.learning_curve(_numeric_documents(spark, sf_dir), "quality", "doc_id", "decision_tree", {"max_depth": 4})


@query("validation_curve")
def validation_curve(spark, sf_dir):
    """Accuracy over the depth of a tree."""
    return cu.validation_curve(_numeric_documents(spark, sf_dir), "quality", "doc_id", "decision_tree")


@query("hide_labels", f"""
WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {_hash(42, 'event_id')}) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_id, CASE WHEN r > least(n - 1, floor(n * 0.3::DOUBLE)) THEN event_type END AS event_type FROM r""")
def hide_labels(spark, sf_dir):
    """A share of each class's labels hidden, at least one kept (L1)."""
    return st.hide_labels(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "event_id", 30)


@query("labeled_holdout", f"""
WITH d AS (SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id)),
n AS (SELECT quality, count(*) AS n FROM d WHERE quality IS NOT NULL GROUP BY 1), t AS (SELECT sum(n) AS t, least(greatest(2, round_even(sum(n) * 0.3::DOUBLE, 0)), sum(n) - 2) AS want FROM n),
w AS (SELECT quality, n, n * want / t AS e, floor(n * want / t) AS f, want FROM n, t),
m AS (SELECT quality, f + CASE WHEN row_number() OVER (ORDER BY e - f DESC, quality) <= want - sum(f) OVER () THEN 1 ELSE 0 END AS m FROM w)
SELECT doc_id, quality, quality IS NOT NULL AND row_number() OVER (PARTITION BY quality ORDER BY {_hash(42, 'doc_id')}) <= m AS holdout FROM d LEFT JOIN m USING (quality)""")
def labeled_holdout(spark, sf_dir):
    """Labelled rows set aside, unlabelled rows stay in training (L2)."""
    docs = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    train, test = st.labeled_holdout(docs, "quality", "doc_id")
    return train.withColumn("holdout", F.lit(False)).unionByName(test.withColumn("holdout", F.lit(True)))


def _partly_labeled(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    words = 1 + F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
    docs = docs.select("doc_id", "n_chars", (F.length("text").cast("double") / words).alias("word_length"))
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")


@query("self_training_export", """
SELECT (SELECT count(*) FROM documents)::BIGINT AS n_rows, (SELECT count(*) FROM labels WHERE quality IS NOT NULL)::BIGINT AS original, TRUE AS consistent""")
def self_training_export(spark, sf_dir):
    """Self-training over partly labelled documents: no row is lost, sources and iterations agree."""
    made = st.self_training_workflow(_partly_labeled(spark, sf_dir), "quality", "doc_id", parameters={"threshold": 0.85, "max_iter": 3})
    src, it, known = F.col("quality_source"), F.col("quality_ssl_iteration"), F.col("quality").isNotNull()
    fine = ((src == "original") & (it == 0) & known) | ((src == "pseudo_labeled") & (it > 0) & known) | ((src == "remaining_unlabeled") & (it == -1) & ~known)
    return made["export"].agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(src == "original").alias("original"), F.coalesce(F.bool_and(fine), F.lit(False)).alias("consistent"))


@query("self_training_history")
def self_training_history(spark, sf_dir):
    """Progress per pass with the best ten rows taken each time."""
    docs = _partly_labeled(spark, sf_dir)
    return st.self_train(docs, "quality", "doc_id", ["n_chars", "word_length"], criterion="k_best", k_best=10, max_iter=3)["history"]


@query("self_training_metrics")
def self_training_metrics(spark, sf_dir):
    """Holdout metrics of a self-trained model."""
    made = st.self_training_workflow(_partly_labeled(spark, sf_dir), "quality", "doc_id", parameters={"max_iter": 2, "hide_labeled_percent": 30})
    return _metrics_row(spark, made)


@query("pseudo_label_export", f"""
WITH e AS (SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type END AS kind, event_type FROM events)
SELECT event_id, CASE WHEN kind IS NULL AND event_type = 'error' THEN 'guess' ELSE kind END AS kind,
  CASE WHEN kind IS NOT NULL THEN 'original' WHEN event_type = 'error' THEN 'pseudo_labeled' ELSE 'remaining_unlabeled' END AS kind_source,
  (CASE WHEN kind IS NOT NULL THEN 0 WHEN event_type = 'error' THEN 2 ELSE -1 END)::BIGINT AS kind_ssl_iteration FROM e""")
def pseudo_label_export(spark, sf_dir):
    """Pseudo-labels written back beside the originals."""
    ev = table(spark, sf_dir, "events")
    rows = ev.select("event_id", F.when(F.col("event_type").isin("click", "view"), F.col("event_type")).alias("kind"))
    pseudo = ev.filter("event_type = 'error'").select("event_id", F.lit("guess").alias("label"), F.lit(2).alias("iteration"))
    return st.export_table(rows, "kind", "event_id", pseudo)


@query("csv_round_trip", f"WITH {SIGNAL_SQL} SELECT event_id, event_type, round(x, 6) + 0.0::DOUBLE AS x, round(y, 6) + 0.0::DOUBLE AS y FROM sig")
def csv_round_trip(spark, sf_dir):
    """A table written as CSV and read back with chosen columns."""
    path = f"{scratch_folder(spark)}/csv-{uuid.uuid4().hex}"
    write_table(signal(spark, sf_dir).select("event_id", "user_id", "event_type", "x", "y"), path)
    return rounded(read_csv(spark, path, ["y", "x", "event_type", "event_id"]), ["x", "y"])


@query("project_round_trip", f"""
WITH {SIGNAL_SQL} SELECT event_id, user_id, round(coalesce(x, (SELECT avg(x) FROM sig)), 6) + 0.0::DOUBLE AS x,
  round((y - (SELECT avg(y) FROM sig)) / (SELECT stddev_pop(y) FROM sig), 6) + 0.0::DOUBLE AS y FROM sig""")
def project_round_trip(spark, sf_dir):
    """A project saved and loaded: its recipe rebuilds the working table."""
    path = f"{scratch_folder(spark)}/project-{uuid.uuid4().hex}"
    data = Dataset(signal(spark, sf_dir).select("event_id", "user_id", "x", "y"), "event_id").impute(["x"]).standardize(["y"])
    pr.save_project(path, data, "event_type")
    return rounded(pr.load_project(spark, path)["dataset"].working(), ["x", "y"])


@query("summary_of_clusters", """
SELECT (l_linenumber - 1)::BIGINT AS cluster, count(*)::BIGINT AS count, 'Cluster ' || (l_linenumber - 1) AS description, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS percentage
FROM lineitem GROUP BY l_linenumber""")
def summary_of_clusters(spark, sf_dir):
    """Sizes and shares of numbered clusters."""
    from tidemark.operators.evaluate import cluster_shares, cluster_summary

    li = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber").cast("bigint") - 1).alias("cluster"))
    both = cluster_summary(li).join(cluster_shares(li).select("cluster", rnd("percentage").alias("percentage")), "cluster")
    return both
