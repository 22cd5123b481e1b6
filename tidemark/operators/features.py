"""Per-column statistics of a whole table: one row per signal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stat_keys import WHOLE_COLUMN_KEYS, sign_bit
from tidemark.plans.ordered import PART, POS, exact_quantiles, range_sorted
from tidemark.plans.roles import c, is_numeric, require_columns


def _number(df: DataFrame, name: str) -> Column:
    x = c(name).cast("double")
    return F.when(~F.isnan(x), x)


def _stacked(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long form (signal, number, text) of the non-missing cells."""
    cells = []
    for name in columns:
        if is_numeric(df, name):
            cells.append(F.struct(F.lit(name).alias("signal"), _number(df, name).alias("num"), F.lit(None).cast("string").alias("txt")))
        else:
            cells.append(F.struct(F.lit(name).alias("signal"), F.lit(None).cast("double").alias("num"), c(name).cast("string").alias("txt")))
    return (
        df.select(F.explode(F.array(*cells)).alias("cell"))
        .select("cell.*")
        .filter(F.col("num").isNotNull() | F.col("txt").isNotNull())
    )


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count of every distinct value per column, combined before the shuffle."""
    return _stacked(df, columns).groupBy("signal", "num", "txt").agg(F.count(F.lit(1)).alias("n"))


def distinct_top_freq(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct count, smallest most frequent value and its count per column."""
    counts = value_counts(df, columns)
    best = F.min_by(F.struct("num", "txt"), F.struct(-F.col("n"), F.col("num"), F.col("txt")))
    return counts.groupBy("signal").agg(
        F.count(F.lit(1)).alias("unique"), best.alias("best"), F.max("n").alias("freq")
    ).select("signal", "unique", F.col("best.num").alias("top_num"), F.col("best.txt").alias("top_txt"), "freq")


def medians(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float] = (0.5,), names: Sequence[str] = ("median",)) -> DataFrame:
    """Exact quantiles of several numeric columns in one pass, one row per column."""
    long = _stacked(df, columns).select("signal", F.col("num").alias("value"))
    return exact_quantiles(long, "value", probabilities, ["signal"], names)


def sign_changes(df: DataFrame, columns: Sequence[str], order_by: Sequence[str | Column]) -> DataFrame:
    """Sign-bit changes between successive known values of each column, in row order.

    Each range partition counts its own changes; the change between two
    partitions needs only the first and last sign of each.
    """
    by = [c(o) if isinstance(o, str) else o for o in order_by]
    signs = [f"_s{i}" for i in range(len(columns))]
    narrow = df.select(
        *[o.alias(f"_o{j}") for j, o in enumerate(by)],
        *[sign_bit(_number(df, n)).alias(s) for n, s in zip(columns, signs)],
    )
    rows = range_sorted(narrow, [f"_o{j}" for j in range(len(by))], (), "signs")
    before = Window.partitionBy(PART).orderBy(POS).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"{s}b": F.last(s, ignorenulls=True).over(before) for s in signs})
    cells = []
    for name, s in zip(columns, signs):
        where = F.when(F.col(s).isNotNull(), F.col(POS))
        cells.append(
            F.struct(
                F.lit(name).alias("signal"),
                F.count_if(F.col(s) != F.col(f"{s}b")).alias("changes"),
                F.min_by(s, where).alias("first"),
                F.max_by(s, where).alias("last"),
            )
        )
    parts = rows.groupBy(PART).agg(F.array(*cells).alias("cells")).select(PART, F.explode("cells").alias("x")).select(PART, "x.*")
    earlier = Window.partitionBy("signal").orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("carry", F.last("last", ignorenulls=True).over(earlier))
    return parts.groupBy("signal").agg(
        (F.sum("changes") + F.count_if(F.col("first") != F.col("carry"))).alias("changes")
    )


def moment_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts, moments and extremes of numeric columns from one aggregation, one row per column."""
    cells = []
    for name in columns:
        x = _number(df, name)
        cells.append(
            F.struct(
                F.lit(name).alias("signal"),
                F.count(x).alias("n"),
                F.avg(x).alias("mean"),
                F.stddev_samp(x).alias("sd"),
                F.var_pop(x).alias("var"),
                F.min(x).alias("min"),
                F.max(x).alias("max"),
                F.skewness(x).alias("g1"),
                F.kurtosis(x).alias("g2"),
                F.avg(x * x).alias("meansq"),
                F.sum(x * x).alias("sumsq"),
            )
        )
    return df.agg(F.count(F.lit(1)).alias("rows"), F.array(*cells).alias("cells")).select(
        "rows", F.explode("cells").alias("x")
    ).select("rows", "x.*")


def corrected_skew(n: Column, g1: Column) -> Column:
    """Bias-corrected skewness; too few values or a constant column give 0."""
    n = n.cast("double")
    return F.when(n > 2, F.coalesce(g1 * F.sqrt(n * (n - 1)) / (n - 2), F.lit(0.0))).when(n > 0, F.lit(0.0))


def corrected_kurtosis(n: Column, g2: Column) -> Column:
    """Bias-corrected excess kurtosis; too few values or a constant column give 0."""
    n = n.cast("double")
    value = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return F.when(n > 3, F.coalesce(value, F.lit(0.0))).when(n > 0, F.lit(0.0))


def column_features(
    df: DataFrame, signals: Sequence[str], keys: Sequence[str], order_by: Sequence[str | Column] = ()
) -> DataFrame:
    """Requested statistics of each signal over the whole table.

    Text signals have counts, distinct values, mode and missing figures; their
    median is the mode and their range the distinct count. ``top`` and
    ``median`` are strings as soon as one of the signals is text.
    """
    signals, keys = list(signals), list(dict.fromkeys(keys))
    require_columns(df, signals, "Signals")
    unknown = [k for k in keys if k not in WHOLE_COLUMN_KEYS]
    if unknown:
        raise ValueError(f"Unknown features: {unknown}")
    numbers = [s for s in signals if is_numeric(df, s)]
    texts = [s for s in signals if s not in numbers]

    base = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.array(
            *[
                F.struct(F.lit(i).alias("ordinal"), F.lit(s).alias("signal"), F.count(_number(df, s) if s in numbers else c(s)).alias("n"))
                for i, s in enumerate(signals)
            ]
        ).alias("cells"),
    ).select("rows", F.explode("cells").alias("x")).select("rows", "x.*")
    out = base
    moment_keys = {"mean", "std", "variance", "min", "max", "range", "p2p", "skew", "kurtosis", "rms", "energy"}
    if numbers and moment_keys & set(keys):
        out = out.join(moment_table(df, numbers).drop("rows", "n"), "signal", "left")
    if {"unique", "top", "freq"} & set(keys) or (texts and {"median", "range"} & set(keys)):
        out = out.join(distinct_top_freq(df, signals), "signal", "left")
    if "median" in keys and numbers:
        out = out.join(medians(df, numbers), "signal", "left")
    if "zcr" in keys and numbers:
        if not order_by:
            raise ValueError("zcr needs order_by: rows have no order of their own.")
        out = out.join(sign_changes(df, numbers, order_by), "signal", "left")

    n, text = F.col("n"), F.col("signal").isin(texts) if texts else F.lit(False)
    have = set(out.columns)

    def col(name: str, kind: str = "double") -> Column:
        return F.col(name) if name in have else F.lit(None).cast(kind)

    mixed_top = F.coalesce(col("top_txt", "string"), col("top_num").cast("string"))
    made = {
        "count": n,
        "unique": F.coalesce(col("unique", "bigint"), F.lit(0)),
        "top": mixed_top if texts else col("top_num"),
        "freq": F.coalesce(col("freq", "bigint"), F.lit(0)),
        "mean": col("mean"),
        "median": F.when(text, col("top_txt", "string")).otherwise(col("median").cast("string")) if texts else col("median"),
        "std": F.when(n > 1, col("sd")).when((n == 1) & ~text, F.lit(0.0)),
        "variance": col("var"),
        "min": col("min"),
        "max": col("max"),
        "range": F.when(text, F.coalesce(col("unique", "bigint"), F.lit(0)).cast("double")).otherwise(col("max") - col("min")),
        "p2p": col("max") - col("min"),
        "skew": F.when(~text, corrected_skew(n, col("g1"))),
        "kurtosis": F.when(~text, corrected_kurtosis(n, col("g2"))),
        "rms": F.sqrt(col("meansq")),
        "energy": col("sumsq"),
        "zcr": F.when(text, F.lit(None)).when(n >= 2, col("changes", "bigint") / (n - 1)).when(n == 1, F.lit(0.0)),
        "missing_count": F.col("rows") - n,
        "missing_pct": F.when(F.col("rows") > 0, (F.col("rows") - n) / F.col("rows") * 100.0).otherwise(F.lit(0.0)),
    }
    return out.orderBy("ordinal").select("signal", *[made[k].alias(k) for k in keys])


def describe_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Description of each column: counts, moments, quartiles, mode and missing share.

    Skewness and kurtosis are the population (biased) ones here.
    """
    columns = list(columns)
    require_columns(df, columns)
    numbers = [s for s in columns if is_numeric(df, s)]
    texts = [s for s in columns if s not in numbers]
    parts = []
    if numbers:
        quart = medians(df, numbers, (0.25, 0.5, 0.75), ("p25", "p50", "p75"))
        m = moment_table(df, numbers).join(quart, "signal", "left")
        parts.append(
            m.select(
                "signal",
                F.col("n").alias("count"),
                F.lit(None).cast("bigint").alias("unique"),
                F.lit(None).cast("string").alias("top"),
                F.lit(None).cast("bigint").alias("freq"),
                "mean",
                F.col("sd").alias("std"),
                "min",
                "p25",
                "p50",
                "p75",
                "max",
                F.when(F.col("n") > 0, F.coalesce("g1", F.lit(0.0))).alias("skew"),
                F.when(F.col("n") > 0, F.coalesce("g2", F.lit(0.0))).alias("kurtosis"),
                F.sqrt("meansq").alias("rms"),
                (F.col("max") - F.col("min")).alias("p2p"),
                F.col("var").alias("variance"),
                F.col("n").alias("total_non_null"),
                (F.col("rows") - F.col("n")).alias("missing_count"),
                F.when(F.col("rows") > 0, (F.col("rows") - F.col("n")) / F.col("rows") * 100.0).otherwise(0.0).alias("missing_pct"),
            )
        )
    if texts:
        base = df.agg(
            F.count(F.lit(1)).alias("rows"),
            F.array(*[F.struct(F.lit(s).alias("signal"), F.count(c(s)).alias("n")) for s in texts]).alias("cells"),
        ).select("rows", F.explode("cells").alias("x")).select("rows", "x.*")
        t = base.join(distinct_top_freq(df, texts), "signal", "left")
        none = [F.lit(None).cast("double").alias(k) for k in ("mean", "std", "min", "p25", "p50", "p75", "max", "skew", "kurtosis", "rms", "p2p", "variance")]
        parts.append(
            t.select(
                "signal",
                F.col("n").alias("count"),
                F.coalesce("unique", F.lit(0)).alias("unique"),
                F.col("top_txt").alias("top"),
                "freq",
                *none,
                F.col("n").alias("total_non_null"),
                (F.col("rows") - F.col("n")).alias("missing_count"),
                F.when(F.col("rows") > 0, (F.col("rows") - F.col("n")) / F.col("rows") * 100.0).otherwise(0.0).alias("missing_pct"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
