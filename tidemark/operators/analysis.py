"""Correlation, principal components, mutual information and feature ranking."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.prepare import fit_preparation
from tidemark.plans.ordered import dealt, running_totals, with_halo, with_row_id
from tidemark.plans.roles import c, nan_to_null, numeric_columns, require_columns
from tidemark.plans.sampling import class_counts

WIDE_COLUMNS = 24  # beyond this the pairs are summed block-wise instead of one aggregate each
MAX_DUMMIES = 2_000


def _pair_table(spark, pairs: dict[tuple[str, str], float | None], columns: Sequence[str]) -> DataFrame:
    rows = []
    for a in columns:
        for b in columns:
            rows.append((a, b, pairs.get((a, b), pairs.get((b, a)))))
    return spark.createDataFrame(rows, "feature_a string, feature_b string, corr double")


def _gram(df: DataFrame, columns: Sequence[str]) -> dict[tuple[str, str], float | None]:
    """Pairwise-complete correlations from per-partition cross products of centred columns."""
    means = df.agg(*[F.avg(c(n)).alias(f"_{i}") for i, n in enumerate(columns)]).first()
    centre = np.array([m if m is not None else 0.0 for m in means], dtype=float)
    width = len(columns)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((6, width, width))
        for pdf in batches:
            x = pdf.to_numpy(dtype=float) - centre
            known = ~np.isnan(x)
            k, x = known.astype(float), np.where(known, x, 0.0)
            total += np.stack([k.T @ k, x.T @ k, k.T @ x, (x * x).T @ k, k.T @ (x * x), x.T @ x])
        i, j = np.triu_indices(width)
        yield pd.DataFrame({"i": i, "j": j, **{f"s{t}": total[t][i, j] for t in range(6)}})

    numbers = df.select(*[c(n).cast("double").alias(f"_{i}") for i, n in enumerate(columns)])
    parts = numbers.mapInPandas(partial, "i int, j int, s0 double, s1 double, s2 double, s3 double, s4 double, s5 double")
    out = {}
    for r in parts.groupBy("i", "j").agg(*[F.sum(f"s{t}").alias(f"s{t}") for t in range(6)]).collect():
        n = r["s0"]
        cov = r["s5"] - r["s1"] * r["s2"] / n if n else 0.0
        va, vb = (r["s3"] - r["s1"] ** 2 / n, r["s4"] - r["s2"] ** 2 / n) if n else (0.0, 0.0)
        out[columns[r["i"]], columns[r["j"]]] = cov / math.sqrt(va * vb) if n > 1 and va > 0 and vb > 0 else None
    return out


def correlation_pairs(df: DataFrame, columns: Sequence[str] | None = None, label: str | None = None) -> DataFrame:
    """Pearson correlation of every column pair over rows where both are known, long form."""
    columns = list(columns) if columns else numeric_columns(df, label)
    require_columns(df, columns)
    if not columns:
        raise ValueError("A correlation needs at least one numeric column.")
    df = nan_to_null(df.select(*[c(n) for n in dict.fromkeys(columns)]))
    if len(columns) > WIDE_COLUMNS:
        return _pair_table(df.sparkSession, _gram(df, columns), columns)
    cells = []
    for i, a in enumerate(columns):
        for b in columns[i:]:
            x, y = c(a).cast("double"), c(b).cast("double")
            # spreads over the rows where both are known; a constant has no correlation
            vx, vy = F.var_pop(F.when(y.isNotNull(), x)), F.var_pop(F.when(x.isNotNull(), y))
            value = F.try_divide(F.covar_pop(x, y), F.sqrt(vx) * F.sqrt(vy)) if a != b else F.when(F.var_pop(x) > 0, F.lit(1.0))
            cells.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), value.alias("corr")))
    pairs = df.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("x")).select("x.*")
    pairs = pairs.withColumn("corr", F.when(~F.isnan("corr"), F.col("corr")))
    both = F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return (
        pairs.select(F.explode(F.array_distinct(both)).alias("p"), "corr")
        .select(F.col("p.a").alias("feature_a"), F.col("p.b").alias("feature_b"), "corr")
    )


def correlation_matrix(
    df: DataFrame, columns: Sequence[str] | None = None, label: str | None = None, digits: int | None = 4, undefined: float | None = None
) -> DataFrame:
    """Square correlation matrix; ``undefined`` replaces correlations of constants (0 for a heatmap)."""
    columns = list(columns) if columns else numeric_columns(df, label)
    pairs = correlation_pairs(df, columns, label)
    return _square(pairs, columns, digits, undefined)


def _square(pairs: DataFrame, columns: Sequence[str], digits: int | None, undefined: float | None) -> DataFrame:
    value: Column = F.col("corr")
    if undefined is not None:
        value = F.coalesce(value, F.lit(float(undefined)))
    if digits is not None:
        value = F.round(value, digits)
    cells = [F.max(F.when(F.col("feature_b") == n, value)).alias(n) for n in columns]
    return pairs.groupBy(F.col("feature_a").alias("feature")).agg(*cells).orderBy("feature")


def category_correlation(df: DataFrame, columns: Sequence[str], digits: int | None = 4, most: int = MAX_DUMMIES) -> DataFrame:
    """Correlation of the one-hot columns of text columns, long form, from pair counts.

    A 0/1 column needs no matrix: its correlation follows from how often two
    categories occur, alone and together. NULL belongs to no category. The
    result has a row per pair of categories; more than ``most`` are refused.
    """
    columns = list(columns)
    require_columns(df, columns)
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("col"), c(n).cast("string").alias("v")) for i, n in enumerate(columns)])
    marked = df.select(F.filter(cells, lambda x: x["v"].isNotNull()).alias("held"))
    singles = marked.select(F.explode("held").alias("x")).select("x.*").groupBy("i", "col", "v").agg(F.count(F.lit(1)).alias("n"))
    found = singles.limit(most + 1).count()
    if found < 2:
        raise ValueError("The chosen text columns have fewer than two categories.")
    if found > most:
        raise ValueError(f"There are more than {most} categories.")
    a, b = marked.select("held", F.explode("held").alias("a")).select("a", F.explode("held").alias("b")), lambda s, n: F.col(f"{s}.{n}")
    together = a.filter(b("a", "i") < b("b", "i")).groupBy(*[b(s, n).alias(f"{s}_{n}") for s in "ab" for n in ("i", "v")]).agg(F.count(F.lit(1)).alias("n11"))
    total = df.count()
    name = lambda s: singles.select(*[F.col(n).alias(f"{s}_{n}") for n in ("i", "col", "v", "n")])
    grid = name("a").join(F.broadcast(name("b")), F.lit(True))  # at most ``most`` rows
    turn = F.col("a_i") <= F.col("b_i")
    keys = {"p_i": F.least("a_i", "b_i"), "p_v": F.when(turn, F.col("a_v")).otherwise(F.col("b_v")), "q_i": F.greatest("a_i", "b_i"), "q_v": F.when(turn, F.col("b_v")).otherwise(F.col("a_v"))}
    known = together.select(F.col("a_i").alias("p_i"), F.col("a_v").alias("p_v"), F.col("b_i").alias("q_i"), F.col("b_v").alias("q_v"), "n11")
    both = grid.withColumns(keys).join(known, list(keys), "left")
    same = (F.col("a_i") == F.col("b_i")) & (F.col("a_v") == F.col("b_v"))
    n11, na, nb = F.when(same, F.col("a_n")).otherwise(F.coalesce("n11", F.lit(0))).cast("double"), F.col("a_n").cast("double"), F.col("b_n").cast("double")
    corr = F.try_divide(n11 * total - na * nb, F.sqrt(na * (total - na) * nb * (total - nb)))
    label = lambda s: F.concat_ws("_", f"{s}_col", f"{s}_v")
    return both.select(label("a").alias("feature_a"), label("b").alias("feature_b"), (corr if digits is None else F.round(corr, digits)).alias("corr"))


def principal_components(
    df: DataFrame,
    features: Sequence[str],
    label: str | None = None,
    n_components: int = 2,
    fill_method: str | None = "median",
    fill_value: Any = None,
    keep: Sequence[str] = (),
) -> dict[str, Any]:
    """Scores on the leading components of the standardised features.

    The sign of a component is fixed so that its largest loading (the first of
    equal ones) is positive. Returns scores, loadings and variance ratios.
    """
    features = [f for f in features if f != label]
    prep = fit_preparation(df, features, fill_method, fill_value, scale=True)
    carried = [*keep, *([label] if label and label in df.columns else [])]
    vectors = prep.vectors(df, carried)
    size = min(int(n_components), len(prep.columns), df.count())
    model = PCA(k=size, inputCol="features", outputCol="_pc").fit(vectors)
    loadings = model.pc.toArray()
    signs = []
    for j in range(size):
        big = np.abs(loadings[:, j])
        first = int(np.flatnonzero(big >= big.max() * (1 - 1e-9))[0])
        signs.append(1.0 if loadings[first, j] >= 0 else -1.0)
    scored = model.transform(vectors).withColumn("_pc", vector_to_array("_pc"))
    cells = [(F.col("_pc")[j] * signs[j]).alias(f"PC{j + 1}") for j in range(size)]
    ratios = [float(v) for v in model.explainedVariance]
    return {
        "scores": scored.select(*[c(n) for n in keep], *cells, *([c(label)] if label in carried else [])),
        "features": list(features),
        "columns": prep.columns,
        "loadings": loadings * np.array(signs),
        "explained_variance_ratio": ratios,
        "explained_variance_sum": sum(ratios),
    }


def _digamma_table(n: int) -> list[float]:
    out, value = [], -0.57721566490153286060651209008240243
    for i in range(1, n + 1):
        out.append(value)
        value += 1.0 / i
    return out


def digamma(n: Column) -> Column:
    """Digamma of a positive integer: exact below 16, asymptotic series above."""
    x = n.cast("double")
    series = F.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6) + 1 / (240 * x**8)
    small = F.element_at(F.array(*[F.lit(v) for v in _digamma_table(15)]), F.least(n, F.lit(15)).cast("int"))
    return F.when(n < 16, small).otherwise(series)


def mutual_information(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    row_id: str,
    fill_method: str | None = "median",
    fill_value: Any = None,
    neighbours: int = 3,
) -> DataFrame:
    """Nearest-neighbour mutual information of each feature with a class label, highest first.

    In one dimension a point's k-th neighbour within its class lies among the
    k rows before and after it in sorted order, and counting points in an
    interval is a difference of two running counts. All features go through
    the same two range sorts, split by size, not by class. Equal values are
    told apart by a tiny offset derived from the row id.
    """
    if not label or label not in df.columns:
        raise ValueError("Mutual information needs a label column.")
    features = [f for f in features if f != label]
    prep = fit_preparation(df, features, fill_method, fill_value)
    matrix = prep.apply(df, [row_id, label])
    names = prep.columns
    stats = matrix.agg(
        *[F.stddev_pop(c(n)).alias(f"s{i}") for i, n in enumerate(names)],
        *[F.avg(F.abs(c(n))).alias(f"a{i}") for i, n in enumerate(names)],
    ).first()
    noise = F.pmod(F.pmod(F.col("rid").cast("bigint"), F.lit(1 << 30)) * F.lit(2654435761), F.lit(4294967296)) / 4294967296.0 - 0.5
    cells = []
    for i, n in enumerate(names):
        sd = stats[f"s{i}"] or 1.0
        size = 1e-10 * max(1.0, (stats[f"a{i}"] or 0.0) / sd)
        cells.append(F.struct(F.lit(n).alias("feature"), (c(n) / sd + noise * size).alias("x")))
    counts = {k: n for k, n in class_counts(df, label).items() if n > 1}
    long = (
        matrix.withColumnRenamed(label, "cls").withColumnRenamed(row_id, "rid")
        .select("rid", "cls", F.explode(F.array(*cells)).alias("f"))
        .select("rid", "cls", "f.feature", "f.x")
        .filter(F.col("cls").isin(list(counts)))
    )
    size = sum(counts.values()) * len(names)
    sorted_rows = with_row_id(long, ["x", "rid"], ["feature", "cls"], "_i", size)
    blocks = dealt(with_halo(sorted_rows, "_i", neighbours, neighbours), ["feature", "cls", "_block"], size)
    near = Window.partitionBy("feature", "cls", "_block").orderBy("_i")
    k = F.lit(neighbours)
    small = {key: n for key, n in counts.items() if n - 1 < neighbours}
    for key, n in small.items():
        k = F.when(F.col("cls") == key, F.lit(n - 1)).otherwise(k)
    for j in range(1, neighbours + 1):
        blocks = blocks.withColumns({f"_p{j}": F.lag("x", j).over(near), f"_n{j}": F.lead("x", j).over(near)})
    own = blocks.filter("_own").withColumn("_k", k)
    options = []
    for j in range(neighbours + 1):
        for m in range(neighbours + 1 - j):
            left = F.col("x") - F.col(f"_p{j}") if j else F.lit(0.0)
            right = F.col(f"_n{m}") - F.col("x") if m else F.lit(0.0)
            lo = F.col(f"_p{j}") if j else F.col("x")
            hi = F.col(f"_n{m}") if m else F.col("x")
            r = F.greatest(left, right)
            valid = (F.col("_k") == j + m) & left.isNotNull() & right.isNotNull()
            # the neighbour that sets the radius bounds the interval by its own value
            on_left = left >= right
            options.append(
                F.when(
                    valid,
                    F.struct(
                        r.alias("r"),
                        F.when(on_left, lo).otherwise(F.col("x") - r).alias("lo"),
                        F.when(on_left, F.col("x") + r).otherwise(hi).alias("hi"),
                    ),
                )
            )
    bounded = own.withColumn("_b", F.array_min(F.array_compact(F.array(*options))))
    points = long.select("feature", F.col("x").alias("v"), F.lit(1).alias("tag"), "rid", F.lit(1).alias("one"))
    ends = bounded.select(
        "feature",
        F.explode(F.array(
            F.struct(F.col("_b.hi").alias("v"), F.lit(0).alias("tag")), F.struct(F.col("_b.lo").alias("v"), F.lit(2).alias("tag"))
        )).alias("e"), "rid",
    ).select("feature", "e.v", "e.tag", "rid", F.lit(0).alias("one"))
    run = running_totals(points.unionByName(ends), ["one"], ["v", "tag", "rid"], ["feature"], rows=3 * size)
    inside = dealt(run.filter("tag <> 1"), ["feature", "rid"], 2 * size).groupBy("feature", "rid").agg(
        F.sum(F.when(F.col("tag") == 0, F.col("cum_one")).otherwise(-F.col("cum_one"))).alias("m")
    )
    total = sum(counts.values())
    mean_k = sum(n * _digamma_table(max(1, min(neighbours, n - 1)))[-1] for n in counts.values()) / total
    mean_class = sum(n * _psi(n) for n in counts.values()) / total
    base = _psi(total) + mean_k - mean_class
    score = F.greatest(F.lit(0.0), F.lit(base) - F.avg(digamma(F.greatest(F.col("m"), F.lit(1)))))
    return inside.groupBy("feature").agg(score.alias("mutual_information")).orderBy(F.desc("mutual_information"), "feature")


def _psi(n: int) -> float:
    if n < 16:
        return _digamma_table(n)[-1]
    return math.log(n) - 1 / (2 * n) - 1 / (12 * n**2) + 1 / (120 * n**4) - 1 / (252 * n**6) + 1 / (240 * n**8)


def top_scores(scores: DataFrame, n: int = 15, score: str = "mutual_information", name: str = "feature") -> DataFrame:
    """Highest scores first."""
    return scores.orderBy(F.desc(score), name).limit(n)


def f_statistics(df: DataFrame, columns: Sequence[str], label: str) -> dict[str, float]:
    """One-way analysis-of-variance F of each column, from per-class moments in one pass."""
    cells = []
    for i, n in enumerate(columns):
        cells += [F.count(c(n)).alias(f"n{i}"), F.avg(c(n)).alias(f"m{i}"), F.var_pop(c(n)).alias(f"v{i}")]
    class_counts(df, label)  # bounds the number of groups
    groups = df.groupBy(c(label)).agg(*cells).collect()
    out = {}
    for i, name in enumerate(columns):
        known = [(r[f"n{i}"], r[f"m{i}"], r[f"v{i}"]) for r in groups if r[f"n{i}"]]
        n = sum(k[0] for k in known)
        mean = sum(k[0] * k[1] for k in known) / n if n else 0.0
        between = sum(k[0] * (k[1] - mean) ** 2 for k in known)
        within = sum(k[0] * k[2] for k in known)
        if len(known) < 2 or n <= len(known):
            out[name] = 0.0
        elif within <= 0:
            out[name] = math.inf if between > 0 else 0.0
        else:
            out[name] = (between / (len(known) - 1)) / (within / (n - len(known)))
    return out


def minimum_redundancy_ranking(
    df: DataFrame, features: Sequence[str], label: str, k: int = 10, fill_method: str | None = "median", fill_value: Any = None
) -> DataFrame:
    """Features that tell most about the label and least about each other, in order.

    Relevance is the F statistic, redundancy the mean absolute correlation with
    the features already chosen. Both come from aggregations; only d and d x d
    numbers reach the driver.
    """
    features = [f for f in features if f != label]
    prep = fit_preparation(df, features, fill_method, fill_value)
    matrix = prep.apply(df, [label])
    names = prep.columns
    relevance = f_statistics(matrix, names, label)
    corr = {(r["feature_a"], r["feature_b"]): r["corr"] for r in correlation_pairs(matrix, names).collect()}
    floor = 0.001
    left = [n for n in names if relevance[n] > 0]
    chosen: list[str] = []
    while left and len(chosen) < min(int(k), len(names)):
        def score(n: str) -> float:
            if not chosen:
                return relevance[n]
            shared = [max(floor, abs(corr.get((n, s)) or 0.0)) for s in chosen]
            return relevance[n] / (sum(shared) / len(shared))

        best = max(left, key=lambda n: (score(n), -names.index(n)))
        chosen.append(best)
        left.remove(best)
    return df.sparkSession.createDataFrame(list(enumerate(chosen, start=1)), "rank long, feature string")
