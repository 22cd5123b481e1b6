"""Kernels that have to stay exact and bounded on wide vectors and large tables, with tiny blocks."""

import numpy as np
import pytest

import tidemark.plans.metric as metric_module
from tidemark.operators import cluster as cl
from tidemark.operators import linkage
from tidemark.operators.dbscan import dbscan
from tidemark.operators.neighbours import accuracy_by_k, nearest_neighbours
from tidemark.plans.metric import Metric, build_cells, pair_distances, screened


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(m, 1.0, (70, 24)) for m in (0.0, 1.5, 3.0)])
    x[20:40] = x[20]
    rows = [(i, i // 70, [float(a) for a in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, label long, x array<double>").cache(), x


@pytest.fixture(autouse=True)
def tiny_blocks(monkeypatch):
    monkeypatch.setattr(metric_module, "ROWS_PER_PIVOT", 30)
    monkeypatch.setattr(metric_module, "CHUNK_ROWS", 32)


def test_screen_decides_as_the_distances_do():
    rng = np.random.default_rng(2)
    a, b = rng.normal(9, 1, (40, 24)), rng.normal(9, 1, (60, 24))
    b[:5] = a[:5]
    d = Metric()(a, b)
    square, error = screened(a, b)
    assert (np.abs(square - d**2) <= error[:, None]).all()
    for radius in (0.0, float(d[7, 9]), float(np.nextafter(d[7, 9], 0)), 6.5):  # also radii that are a distance
        assert (Metric().within(a, b, radius) == (d <= radius)).all()
    assert (pair_distances(a, b[:40]) == np.diag(d[:, :40])).all()
    assert screened(a * 1e20, b) is None and (Metric().within(a * 1e20, b, 1e21) == (Metric()(a * 1e20, b) <= 1e21)).all()


@pytest.mark.parametrize("metric", [Metric(), Metric("minkowski", 1)])
def test_wide_tables_are_one_cell_of_few_chunks(wide, metric):
    df, x = wide
    cells = build_cells(df.select("id", "x"), metric)
    assert len(cells.pivots) == 1 and cells.chunk_rows == 32  # copies sent grow with rows / chunk, not with cells
    got = nearest_neighbours(df, df, 6, metric, "id", "id").toPandas().sort_values(["qid", "rank"])
    d = metric(x, x)
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), d.shape), d), axis=1)[:, :6]
    assert (got.id.to_numpy().reshape(-1, 6) == order).all()
    assert np.allclose(got.distance.to_numpy().reshape(-1, 6), np.take_along_axis(d, order, 1), atol=0)


def test_wide_dbscan(wide):
    df, x = wide
    near = Metric()(x, x) <= 5.6
    core = near.sum(1) >= 6
    got = dbscan(df, 5.6, 6).toPandas().sort_values("id")
    assert (got.core.to_numpy() == core).all()
    label = np.arange(len(x))
    for _ in range(len(x)):
        label[core] = [label[core & near[i]].min() for i in np.flatnonzero(core)]
    rank = {r: i for i, r in enumerate(sorted(set(label[core])))}
    want = [rank[label[i]] if core[i] else min((rank[r] for r in label[core & near[i]]), default=-1) for i in range(len(x))]
    assert got.cluster.tolist() == want


def test_accuracy_over_k_broadcasts_no_rows(spark, wide):
    df, x = wide
    folds = df.withColumn("fold", (df.id % 3).cast("int"))
    out = accuracy_by_k(folds, "label", 4)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    d, fold, label = Metric()(x, x), np.arange(len(x)) % 3, np.arange(len(x)) // 70
    want = np.zeros((3, 4))
    for f in range(3):
        for k in range(1, 5):
            right = []
            for i in np.flatnonzero(fold == f):
                others = np.flatnonzero(fold != f)
                best = others[np.lexsort((others, d[i, others]))[:k]]
                right.append(np.bincount(label[best]).argmax() == label[i])
            want[f, k - 1] = np.mean(right)
    assert np.allclose([r.accuracy for r in out.collect()], want.mean(0))


def test_line_tree_is_linear(spark, monkeypatch):
    monkeypatch.setattr(cl, "_prim", None)  # no complete graphs on a line
    x = [7.0, 1.0, 1.0, 4.5, None, float("nan"), -2.0]
    df = spark.createDataFrame([(i, [v]) for i, v in enumerate(x)], "id long, x array<double>")
    tree = sorted((r.u, r.v, r.w) for r in cl.spanning_tree(df, chunk=2).collect())
    assert tree == [(0, 3, 2.5), (1, 2, 0.0), (1, 6, 3.0), (2, 3, 3.5)]
    got = {r.id: r.cluster for r in cl.hierarchical(df, 2, "single").collect()}
    assert got[0] == got[3] and got[1] == got[2] == got[6] and len({got[0], got[1], got[4], got[5]}) == 4


@pytest.mark.parametrize("width", [1, 2])
def test_ward_cells_follow_the_sequential_tree(spark, monkeypatch, width):
    turns = []
    whole = linkage._block_turn
    monkeypatch.setattr(linkage, "_block_turn", lambda *a: turns.append(a[1]) or whole(*a))
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(0, 1, (500, width)), 9)
    x[:30] = x[0]
    df = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id long, x array<double>")
    got = linkage.ward_merges(df, block=120).toPandas()
    want = sorted(h for _, _, h in cl.linkage_merges(x, "ward"))
    assert np.allclose(np.sort(got.height), want, rtol=1e-6, atol=1e-7) and len(got) == 499
    assert (got["size"] >= 2).all() and got["size"].max() == 500
    assert all(left < 250 for left in turns)  # blocks are compared only among the few clusters that cells leave


def test_ward_repeated_ids_end(spark):
    df = spark.createDataFrame([(i // 2, [float(i // 2)]) for i in range(40)], "id long, x array<double>")
    assert linkage.ward_merges(df, block=8).count() == 39


@pytest.mark.parametrize("kind", ["average", "complete"])
def test_linkage_by_rounds_follows_the_sequential_tree(spark, wide, monkeypatch, kind):
    df, x = wide
    df, x = df.filter("id < 20 OR id >= 40"), np.delete(x, np.s_[20:40], axis=0)
    monkeypatch.setattr(linkage, "STRIP", 7)
    _, merges = linkage.linked_merges(df, kind, block=100, last=60)
    want = [h for _, _, h in cl.linkage_merges(x, kind)]
    assert np.allclose(np.sort(merges.toPandas().height), np.sort(want), rtol=1e-9)
    here = cl.hierarchical(df, 6, kind).toPandas().sort_values("id").cluster.tolist()
    monkeypatch.setattr(cl, "MOST_LINKED", 50)  # it used to refuse more rows than that
    assert cl.hierarchical(df, 6, kind).toPandas().sort_values("id").cluster.tolist() == here


@pytest.mark.parametrize("kind,metric,limits", [("average", "euclidean", {}), ("average", "euclidean", {"pairs": 500}), ("complete", "manhattan", {"pairs": 500}), ("average", "cosine", {"pairs": 500})])
def test_linkage_of_a_chain_measures_all_pairs_few_times(spark, monkeypatch, kind, metric, limits):
    rng = np.random.default_rng(4)
    chain = np.cumsum(1.0 + 0.01 * np.arange(120))[:, None] * [1.0, 0.5, 0.0, 0.2] + rng.normal(0, 0.01, (120, 4))  # one reciprocal pair at a time
    x = np.concatenate([chain, rng.normal(30, 20, (60, 4)), np.tile(chain[7], (9, 1)), np.zeros((2, 4))])
    df = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id long, x array<double>")
    names, write = [], linkage.materialise
    monkeypatch.setattr(linkage, "materialise", lambda df, name="step": names.append(name) or write(df, name))
    _, merges = linkage.linked_merges(df, kind, metric, block=90, last=25, **limits)
    got, want = merges.toPandas(), [h for _, _, h in cl.linkage_merges(x, kind, metric)]
    assert np.allclose(np.sort(got.height), np.sort(want), rtol=1e-9, atol=1e-9) and got.absorbed.nunique() == len(x) - 1
    assert sum(name in ("linked-nearest", "linked-pairs") for name in names) <= 10


def test_silhouette_measures_each_pair_once(spark, wide, monkeypatch):
    df, x = wide
    seen = []
    monkeypatch.setattr(cl, "SILHOUETTE_CHUNK", 16)
    from tidemark.operators.prepare import vector_from_array

    got = cl.silhouette_exact(vector_from_array(df.withColumnRenamed("label", "cluster"), "x"), {0: 70, 1: 70, 2: 70}, 210)
    d, label = Metric()(x, x), np.arange(210) // 70
    for i in range(210):
        means = [d[i, label == k].sum() / (69 if k == label[i] else 70) for k in range(3)]
        a, b = means[label[i]], min(m for k, m in enumerate(means) if k != label[i])
        seen.append((b - a) / max(a, b))
    assert got == pytest.approx(np.mean(seen), abs=1e-12)
    assert np.allclose(metric_module.product_distances(x, x), d, atol=1e-9) and (np.diag(metric_module.product_distances(x, x)) == 0).all()
