"""Correlation, components, information and curves against direct computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import analysis as an
from tidemark.operators import evaluate as ev


def test_perfect_correlation(spark):
    df = spark.createDataFrame([(1, 3), (2, 4), (3, 5)], "a long, b long")
    assert [r["corr"] for r in an.correlation_pairs(df).collect()] == pytest.approx([1.0] * 4)


def test_nan_counts_as_missing_in_correlations(spark, monkeypatch):
    rows = [(1.0, 2.0, 1.0), (2.0, float("nan"), 0.0), (3.0, 5.0, None), (4.0, 9.0, 2.0), (5.0, 8.0, 7.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    want = df.toPandas().corr()
    for wide in (24, 1):
        monkeypatch.setattr(an, "WIDE_COLUMNS", wide)
        for r in an.correlation_pairs(df).collect():
            assert r["corr"] == pytest.approx(want.loc[r["feature_a"], r["feature_b"]])


def test_wide_and_narrow_correlation_agree(students, monkeypatch):
    cols = ["score", "grade", "essay"]
    gappy = students.withColumn("essay", F.when(F.col("essay") > 2.5, F.col("essay")))
    want = {(r[0], r[1]): r[2] for r in an.correlation_pairs(gappy, cols).collect()}
    monkeypatch.setattr(an, "WIDE_COLUMNS", 1)
    got = {(r[0], r[1]): r[2] for r in an.correlation_pairs(gappy, cols).collect()}
    pdf = gappy.select(*cols).toPandas().corr()
    for key, value in want.items():
        assert got[key] == pytest.approx(value, abs=1e-10) and value == pytest.approx(pdf.loc[key], abs=1e-10)


def test_components_ignore_the_label(students):
    out = an.principal_components(students, ["score", "essay", "grade", "research"], "research", 2, keep=["student"])
    assert out["columns"] == ["score", "essay", "grade"]
    x = students.orderBy("student").select("score", "essay", "grade").toPandas().to_numpy(dtype=float)
    z = (x - x.mean(0)) / x.std(0)
    values, vectors = np.linalg.eigh(np.cov(z.T))
    assert out["explained_variance_ratio"] == pytest.approx((values[::-1] / values.sum())[:2])
    got = out["scores"].orderBy("student").toPandas()
    want = z @ vectors[:, ::-1][:, :2]
    for j in range(2):
        assert np.allclose(np.abs(got[f"PC{j + 1}"]), np.abs(want[:, j]), atol=1e-8)
    assert (out["loadings"][np.abs(out["loadings"]).argmax(0), [0, 1]] > 0).all()


def test_digamma(spark):
    row = spark.range(1).select(*[an.digamma(F.lit(n)).alias(f"d{n}") for n in (1, 2, 15, 16, 1000)]).first()
    assert row["d1"] == pytest.approx(-0.5772156649015329) and row["d2"] == pytest.approx(0.42278433509846714)
    assert row["d16"] == pytest.approx(row["d15"] + 1 / 15, abs=1e-12) and row["d1000"] == pytest.approx(6.907255195648812)


def test_information_with_small_classes(spark):
    rng = np.random.default_rng(5)
    labels = np.array(["a"] * 60 + ["b"] * 40 + ["c"] * 2 + ["d"])
    x = rng.normal(size=len(labels)) + (labels == "b") * 2.0
    df = spark.createDataFrame([(i, str(c), float(v)) for i, (c, v) in enumerate(zip(labels, x))], "id long, c string, x double")
    got = an.mutual_information(df, ["x"], "c", "id").first()["mutual_information"]
    scaled = x / x.std()
    noise = ((np.arange(len(x)) * 2654435761) % 4294967296 / 4294967296.0 - 0.5) * 1e-10 * max(1.0, np.abs(scaled).mean())
    scaled = scaled + noise
    keep = labels != "d"
    v, c = scaled[keep], labels[keep]
    psi = an._psi
    total, ks, ns, ms = len(v), [], [], []
    for i in range(total):
        same = np.sort(np.abs(v[c == c[i]] - v[i]))
        k = min(3, len(same) - 1)
        ks.append(psi(k))
        ns.append(psi(len(same)))
        ms.append(psi(int((np.abs(v - v[i]) < same[k]).sum())))
    assert got == pytest.approx(max(0.0, psi(total) + np.mean(ks) - np.mean(ns) - np.mean(ms)), abs=1e-9)


def test_ranking_skips_redundant_features(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 300)
    a = y + rng.normal(0, 0.4, 300)
    b = y + rng.normal(0, 0.45, 300)
    df = spark.createDataFrame([(int(t), float(u), float(u * 2 + 1e-3 * n), float(w)) for t, u, w, n in zip(y, a, b, rng.normal(size=300))], "y long, a double, copy double, b double")
    ranked = [r["feature"] for r in an.minimum_redundancy_ranking(df, ["a", "copy", "b"], "y", 3).orderBy("rank").collect()]
    assert set(ranked[:1]) <= {"a", "copy"} and ranked[1] == "b"


def test_metrics_and_curves(spark):
    df = spark.createDataFrame([("n", 0.1), ("p", 0.4), ("n", 0.35), ("p", 0.8)], "y string, s double")
    binary, positive = ev.clean_binary(df, "y", "s")
    assert positive == "p" and ev.roc_auc(binary).first()["auc"] == pytest.approx(1.0)
    mixed, _ = ev.clean_binary(df.withColumn("s", F.when(F.col("s") == 0.4, 0.35).otherwise(F.col("s"))), "y", "s")
    assert ev.roc_auc(mixed).first()["auc"] == pytest.approx(0.875)
    assert ev.precision_recall_auc(mixed).first()["auc"] == pytest.approx(0.5 + 0.5 * (1 + 2 / 3) / 2)
    with pytest.raises(ValueError, match="two labels"):
        ev.clean_binary(df.filter("y = 'n'"), "y", "s")
    said = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "c")], "y string, p string")
    row = ev.classification_metrics(said, "y", "p").first()
    assert row["accuracy"] == pytest.approx(1 / 3) and row["precision"] == pytest.approx(2 / 3) and row["f1"] == pytest.approx(4 / 9)
    assert ev.confusion_matrix(said, "y", "p").count() == 9
