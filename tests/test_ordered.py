"""Row ids, running totals, quantiles and exact selections do not depend on partitioning."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.plans import sampling
from tidemark.plans.ordered import exact_quantiles, running_totals, with_halo, with_row_id


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of all rows; there are NULL keys and repeated values."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(1500):
        key = "hot" if i % 3 == 0 else (None if i % 50 == 1 else f"k{i % 7}")
        rows.append((i, key, float(rng.integers(0, 40)), int(rng.integers(0, 5))))
    return spark.createDataFrame(rows, "id long, key string, v double, n long")


@pytest.mark.parametrize("partitions", [1, 40])
def test_row_id_is_dense_per_key(skewed, partitions):
    got = with_row_id(skewed.repartition(partitions), ["v", "id"], ["key"])
    want = F.row_number().over(Window.partitionBy("key").orderBy("v", "id")) - 1
    assert got.count() == 1500
    assert got.withColumn("w", want).filter("w <> row_id").count() == 0


def test_row_id_without_key(skewed):
    rows = with_row_id(skewed, [F.desc("id")]).select("id", "row_id").collect()
    assert all(r["row_id"] == 1499 - r["id"] for r in rows)


def test_running_totals(skewed):
    got = running_totals(skewed, ["n"], ["v", "id"], ["key"])
    want = F.sum("n").over(Window.partitionBy("key").orderBy("v", "id").rowsBetween(Window.unboundedPreceding, 0))
    assert got.count() == 1500
    assert got.withColumn("w", want).filter("w <> cum_n").count() == 0


def test_exact_quantiles(skewed):
    got = {r["key"]: (r["a"], r["b"]) for r in exact_quantiles(skewed, "v", [0.1, 0.5], ["key"], ["a", "b"]).collect()}
    pdf = skewed.toPandas()
    for key, part in pdf.groupby("key", dropna=False):
        key = None if key != key else key
        assert got[key] == pytest.approx(tuple(np.quantile(part["v"], [0.1, 0.5])))
    assert exact_quantiles(skewed, "v", [0.5], names=["m"]).first()["m"] == np.median(pdf["v"])


def test_halo_blocks_show_neighbours(spark):
    df = spark.range(1000).withColumnRenamed("id", "i")
    blocks = with_halo(df, "i", lookback=3, lookahead=1, block_rows=50)
    w = Window.partitionBy("_block").orderBy("i")
    out = blocks.withColumns({"p": F.lag("i", 3).over(w), "n": F.lead("i").over(w)}).filter("_own")
    assert out.count() == 1000
    assert out.filter("i >= 3 AND (p IS NULL OR p <> i - 3)").count() == 0
    assert out.filter("i < 999 AND (n IS NULL OR n <> i + 1)").count() == 0


@pytest.mark.parametrize("small", [5, 4096])
def test_hash_groups_have_exact_sizes(skewed, monkeypatch, small):
    monkeypatch.setattr(sampling, "_SMALL", small)
    known = skewed.filter("key IS NOT NULL")
    counts = sampling.class_counts(known, "key")
    wanted = {k: [n // 4, n // 2] for k, n in counts.items()}
    got = sampling.hash_rank_group(known, "id", 9, wanted, "key").groupBy("key", "_group").count().collect()
    found = {(r["key"], r["_group"]): r["count"] for r in got}
    for k, n in counts.items():
        assert [found[k, i] for i in range(3)] == [n // 4, n // 2 - n // 4, n - n // 2]
