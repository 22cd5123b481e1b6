"""Ward linkage by reciprocal nearest neighbours against the sequential algorithm."""

import numpy as np
import pytest

from tidemark.operators import cluster as cl
from tidemark.operators import linkage


def sequential(points, k):
    group = np.arange(len(points))
    merges = cl.linkage_merges(points, "ward")
    for i, j, _ in merges[: len(points) - k]:
        group[group == group[j]] = group[i]
    return merges, group


@pytest.mark.parametrize("seed,block", [(1, 2048), (2, 16), (3, 7)])
def test_ward_matches_sequential(spark, seed, block, monkeypatch):
    monkeypatch.setattr(linkage, "BLOCK", block)
    rng = np.random.default_rng(seed)
    pts = np.vstack([rng.normal(c, 0.6, (25, 2)) for c in ([0, 0], [5, 1], [2, 6])])
    rows = [(i * 3 + 1, [float(a), float(b)]) for i, (a, b) in enumerate(pts)]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    merges, group = sequential(pts, 4)
    got = linkage.ward_merges(df, block=block).collect()
    assert len(got) == len(pts) - 1
    assert np.allclose(sorted(r.height for r in got), sorted(h for _, _, h in merges), rtol=1e-9, atol=1e-9)
    cut = {r.id: r.cluster for r in linkage.ward_clusters(df, 4).collect()}
    by_seq = {}
    for (i, _), g in zip(rows, group):
        by_seq.setdefault(g, set()).add(i)
    by_spark = {}
    for i, cid in cut.items():
        by_spark.setdefault(cid, set()).add(i)
    assert sorted(map(sorted, by_seq.values())) == sorted(map(sorted, by_spark.values()))
    assert sorted(set(cut.values())) == [0, 1, 2, 3]


def test_ward_odd_rows(spark):
    rows = [(1, [0.0]), (2, [0.0]), (3, [1.0]), (None, [5.0]), (4, None), (5, [None])]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    got = sorted((r.kept, r.absorbed, round(r.height, 9)) for r in linkage.ward_merges(df).collect())
    assert got == [(1, 2, 0.0), (1, 3, round(np.sqrt(2 * 2 / 3), 9))]
    assert linkage.ward_merges(df.limit(0)).count() == 0
    assert {r.id: r.cluster for r in linkage.ward_clusters(df.filter("id < 4"), 2).collect()} == {1: 0, 2: 0, 3: 1}
