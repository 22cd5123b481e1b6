"""Neighbour search, density clustering and components against brute force, with tiny blocks."""

import numpy as np
import pytest

import tidemark.plans.metric as metric_module
from tidemark.operators import cluster as cl
from tidemark.operators.dbscan import dbscan
from tidemark.operators.neighbours import knn_classify, nearest_neighbours
from tidemark.operators.prepare import vector_from_array
from tidemark.plans.graph import connected_components
from tidemark.plans.metric import Metric


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(1)
    x = np.round(np.concatenate([rng.normal(0, 0.3, (120, 2)), rng.normal(3, 0.4, (120, 2)), rng.uniform(-2, 5, (60, 2))]), 2)
    x[10:110] = x[10]  # a third of all rows are copies of one point
    return spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id long, x array<double>"), x


@pytest.fixture(autouse=True)
def tiny_blocks(monkeypatch):
    monkeypatch.setattr(metric_module, "ROWS_PER_PIVOT", 60)
    monkeypatch.setattr(metric_module, "CHUNK_ROWS", 50)
    monkeypatch.setattr(metric_module, "SLICE_ROWS", 40)


@pytest.mark.parametrize("name,p", [("euclidean", 2), ("minkowski", 3), ("cosine", 2)])
def test_neighbours(cloud, name, p):
    df, x = cloud
    measure = Metric(name, p)
    got = nearest_neighbours(df, df, 6, measure, "id", "id").toPandas().sort_values(["qid", "rank"])
    assert np.allclose(got.distance.to_numpy().reshape(-1, 6), np.sort(measure(x, x), 1)[:, :6], atol=1e-12)


def test_votes(spark):
    train = spark.createDataFrame([(0, [0.0], "b"), (1, [1.0], "a"), (2, [3.0], "b")], "id long, x array<double>, label string")
    ask = spark.createDataFrame([(7, [0.5]), (8, [3.0])], "qid long, x array<double>")
    uniform = {r["qid"]: r["prediction"] for r in knn_classify(train, ask, "label", 2).collect()}
    assert uniform == {7: "a", 8: "a"}  # ties go to the smallest class
    exact = {r["qid"]: (r["prediction"], r["confidence"]) for r in knn_classify(train, ask, "label", 3, "distance").collect()}
    assert exact[8] == ("b", 1.0)


def reference_dbscan(x, eps, least, measure):
    near = measure(x, x) <= eps
    core, label, number = near.sum(1) >= least, np.full(len(x), -1), 0
    for i in range(len(x)):
        if label[i] != -1 or not core[i]:
            continue
        stack = [i]
        label[i] = number
        while stack:
            j = stack.pop()
            if core[j]:
                for k in np.flatnonzero(near[j]):
                    if label[k] == -1:
                        label[k] = number
                        stack.append(k)
        number += 1
    return label, core


@pytest.mark.parametrize("name,eps,least", [("euclidean", 0.25, 5), ("chebyshev", 0.15, 8), ("cosine", 0.0005, 4)])
def test_dbscan(cloud, name, eps, least):
    df, x = cloud
    got = dbscan(df, eps, least, name).toPandas().sort_values("id")
    label, core = reference_dbscan(x, eps, least, Metric(name))
    assert (got.cluster.to_numpy() == label).all() and (got.core.to_numpy() == core).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(120)] + [(500 + i, 700) for i in range(60)] + [(900, 901)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long"), 10).collect()}
    assert {got[i] for i in range(121)} == {0} and {got[500 + i] for i in range(60)} == {500} and got[901] == 900


@pytest.mark.parametrize("linkage", ["ward", "complete", "average", "single"])
def test_linkage_finds_separate_groups(spark, linkage):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(m, 0.2, (15, 2)) for m in (0, 5, 10)])
    df = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id long, x array<double>")
    got = cl.hierarchical(df, 3, linkage).toPandas().sort_values("id").cluster.to_numpy()
    assert (got == np.repeat([0, 1, 2], 15)).all()
    heights = cl.linkage_distances(df).toPandas().distance.to_numpy()
    assert len(heights) == 44 and (np.diff(heights) >= 0).all()


@pytest.mark.parametrize("rows", [90, 300])
def test_single_linkage_follows_chains_of_any_size(spark, monkeypatch, rows):
    monkeypatch.setattr(cl, "TREE_CHUNK", 64)
    third = rows // 3
    x = [(float(i), 0.0) for i in range(third)] + [(float(i), 50.0) for i in range(rows - third)]
    df = spark.createDataFrame([(i, list(v)) for i, v in enumerate(x)], "id long, x array<double>")
    tree = cl.spanning_tree(df, chunk=64).toPandas()
    assert len(tree) == rows - 1 and sorted(tree.w)[-1] == 50.0 and sorted(tree.w)[-2] == 1.0
    got = cl.hierarchical(df, 2, "single").toPandas().sort_values("id").cluster.to_numpy()
    assert (got == np.repeat([0, 1], [third, rows - third])).all()


def test_other_linkages_refuse_more_rows_than_allowed(spark):
    df = spark.createDataFrame([(i, [float(i)]) for i in range(30)], "id long, x array<double>")
    for make in (lambda: cl.hierarchical(df, 2, "complete", max_rows=29), lambda: cl.linkage_distances(df, linkage="average", max_rows=29)):
        with pytest.raises(ValueError, match="max_rows"):
            make()
    assert cl.hierarchical(df, 2, "complete", max_rows=30).count() == 30
    assert cl.hierarchical(df, 2, "ward", max_rows=29).count() == 30  # Ward is built on the cluster at any size


def test_ward_heights():
    merges = cl.linkage_merges(np.array([[0.0], [1.0], [5.0]]))
    assert [h for _, _, h in merges] == pytest.approx([1.0, np.sqrt(4 / 3) * 4.5])


def test_cluster_metrics(spark, monkeypatch):
    monkeypatch.setattr(cl, "SILHOUETTE_CHUNK", 16)
    x = np.array([[0.0, 0.0], [0.0, 1.0], [4.0, 0.0], [4.0, 1.0], [9.0, 9.0], [50.0, 50.0]])
    k = [0, 0, 1, 1, 2, -1]
    df = spark.createDataFrame([(i, int(c), [float(a) for a in r]) for i, (c, r) in enumerate(zip(k, x))], "id long, cluster long, x array<double>")
    got = cl.clustering_metrics(vector_from_array(df, "x"), silhouette="exact")
    d = Metric()(x[:5], x[:5])
    far = [min((d[i, 2] + d[i, 3]) / 2, d[i, 4]) for i in (0, 1)] + [min((d[i, 0] + d[i, 1]) / 2, d[i, 4]) for i in (2, 3)]
    want = np.mean([(b - 1.0) / max(b, 1.0) for b in far] + [0.0])
    assert got["silhouette_score"] == pytest.approx(want) and got["noise_count"] == 1 and got["cluster_count"] == 3
    assert cl.clustering_metrics(vector_from_array(df.filter("cluster = 0"), "x"))["silhouette_score"] is None


@pytest.mark.parametrize(
    "method,parameters,text",
    [("kmeans", {"n_clusters": 1}, "from 2"), ("kmeans", {"n_clusters": 99}, "number of rows"), ("dbscan", {"eps": 0}, "eps"), ("dbscan", {"min_samples": 0}, "min_samples"),
     ("hierarchical", {"linkage": "ward", "metric": "cosine"}, "Ward"), ("hierarchical", {"linkage": "single", "metric": "typo"}, "one of"), ("other", {}, "Unknown")],
)
def test_clustering_refusals(method, parameters, text):
    with pytest.raises(ValueError, match=text):
        cl.check_clustering(method, 10, ["a"], parameters)
