"""Profiling tables and row-quality flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.ordered import join_on_keys
from tidemark.plans.roles import c, is_datetime, is_fractional, is_numeric, require_columns


def missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN in a fractional column."""
    return c(name).isNull() | F.isnan(c(name)) if is_fractional(df, name) else c(name).isNull()


def _cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row count and missing count of each column from a single aggregation."""
    made = [
        F.struct(
            F.lit(i).alias("ordinal"),
            F.lit(n).alias("column"),
            F.lit(df.schema[n].dataType.simpleString()).alias("dtype"),
            F.count_if(missing(df, n)).alias("missing"),
        )
        for i, n in enumerate(columns)
    ]
    return df.agg(F.count(F.lit(1)).alias("rows"), F.array(*made).alias("cells")).select(
        "rows", F.explode("cells").alias("x")
    ).select("rows", "x.*")


def distinct_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Each distinct row once with its number of copies (NULL equals NULL)."""
    names = list(columns or df.columns)
    return df.groupBy(*[c(n) for n in names]).agg(F.count(F.lit(1)).alias("_copies"))


def table_summary(
    df: DataFrame, columns: Sequence[str] | None = None, project: dict[str, object] | None = None, size: bool = False
) -> DataFrame:
    """Rows, columns, missing cells and duplicate rows as (metric, value); with ``size`` also the planned size.

    ``project`` entries (project, dataset, label, feature rows) come first when given.
    """
    names = list(columns or df.columns)
    total = _cells(df, names).agg(F.max("rows").alias("rows"), F.sum("missing").alias("missing"))
    copies = distinct_rows(df, names).agg(F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicates"))
    rows = [
        ("Rows", F.col("rows").cast("string")),
        ("Columns", F.lit(str(len(names)))),
        ("Missing Cells", F.col("missing").cast("string")),
        ("Duplicate Rows", F.col("duplicates").cast("string")),
    ]
    if size:
        planned = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
        rows.append(("Memory", F.lit(f"{planned / 1024:.1f} KB")))
    extra = [(k, F.lit(str(v))) for k, v in (project or {}).items()]
    pairs = [F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in [*extra, *rows]]
    one = total.join(F.broadcast(copies), F.lit(True), "inner")  # one row on each side
    return one.filter("rows > 0").select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


def missing_summary(df: DataFrame) -> DataFrame:
    """Type, missing count and missing share (text, two decimals) of every column."""
    share = F.format_string("%.2f%%", F.col("missing") / F.col("rows") * 100.0)
    return _cells(df, df.columns).filter("rows > 0").orderBy("ordinal").select("column", "dtype", "missing", share.alias("missing_pct"))


def missing_counts(df: DataFrame, only_missing: bool = True) -> DataFrame:
    """Missing cells per column, by default only of columns that have any."""
    out = _cells(df, df.columns)
    if only_missing:
        out = out.filter("missing > 0")
    return out.orderBy("ordinal").select("column", F.col("missing").alias("missing_count"))


def date_like_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns that are dates or whose values parse as dates at least half of the time.

    Bare numbers always parse: they are read as offsets from the epoch.
    """
    names = list(columns or df.columns)
    cells = []
    for n in names:
        if is_datetime(df, n) or is_numeric(df, n):
            good = F.count(c(n)) if is_numeric(df, n) else F.count(F.lit(1))
        else:
            good = F.count(F.try_to_timestamp(c(n).cast("string")))
        cells.append(F.struct(F.lit(n).alias("column"), F.lit(is_datetime(df, n)).alias("typed"), good.alias("parsed")))
    one = df.agg(F.count(F.lit(1)).alias("rows"), F.array(*cells).alias("cells"))
    enough = (F.col("parsed") > 0) & (F.col("parsed") >= F.greatest(F.lit(1), F.floor(F.col("rows") / 2)))
    return (
        one.select("rows", F.explode("cells").alias("x"))
        .select("rows", "x.*")
        .filter((F.col("rows") > 0) & (F.col("typed") | enough))
        .select("column", "parsed")
    )


def flag_missing_rows(df: DataFrame, columns: Sequence[str] | None = None, name: str = "has_missing") -> DataFrame:
    """Mark rows with any missing cell."""
    names = list(columns or df.columns)
    flag = F.lit(False)
    for n in names:
        flag = flag | missing(df, n)
    return df.withColumn(name, flag)


def drop_missing_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Keep only rows without any missing cell."""
    return df.dropna("any", subset=list(columns) if columns else None)


def flag_duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None, name: str = "is_duplicate") -> DataFrame:
    """Mark every copy of a row that occurs more than once.

    Copies are counted with map-side combining and joined back, so a row that
    makes up a third of the table is one counter, not one window partition.
    """
    names = list(columns or df.columns)
    repeated = distinct_rows(df, names).filter("_copies > 1").select(*[c(n) for n in names], F.lit(True).alias("_dup"))
    return join_on_keys(df, repeated, names, "left").withColumn(name, F.coalesce("_dup", F.lit(False))).drop("_dup")


def remove_duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None, keep: str = "none", order_by: Sequence[str] = ()) -> DataFrame:
    """Remove repeated rows: every copy (``keep="none"``) or all but the first."""
    names = list(columns or df.columns)
    others = [n for n in df.columns if n not in names]
    if keep == "none":
        if not others:
            return distinct_rows(df, names).filter("_copies = 1").drop("_copies")
        # a group of one row hands its other columns through unchanged
        agg = [F.count(F.lit(1)).alias("_copies"), *[F.first(c(n)).alias(n) for n in others]]
        return df.groupBy(*[c(n) for n in names]).agg(*agg).filter("_copies = 1").select(*[c(n) for n in df.columns])
    if keep == "first":
        if not others:
            return df.dropDuplicates(names)
        by = F.struct(*[c(o) for o in (order_by or others)])
        best = df.groupBy(*[c(n) for n in names]).agg(F.min_by(F.struct(*[c(n) for n in others]), by).alias("_first"))
        return best.select(*names, "_first.*").select(*[c(n) for n in df.columns])
    raise ValueError("keep must be 'none' or 'first'.")


def quality_issues(df: DataFrame, row_id: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows that are incomplete or repeated, with what is wrong, by original row id."""
    names = [n for n in (columns or df.columns) if n != row_id]
    marked = flag_duplicate_rows(flag_missing_rows(df, names), names)
    issue = F.concat_ws(
        " & ", F.when(F.col("has_missing"), "Missing"), F.when(F.col("is_duplicate"), "Duplicate")
    )
    return (
        marked.withColumn("issue", issue)
        .filter("issue <> ''")
        .select(c(row_id).alias("original_index"), "issue", *[c(n) for n in names])
        .orderBy("original_index")
    )


def remove_rows(df: DataFrame, row_id: str, ids: DataFrame) -> DataFrame:
    """Drop the listed rows."""
    require_columns(df, [row_id])
    return df.join(ids.select(c(ids.columns[0]).alias(row_id)), row_id, "left_anti")


def split_labeled(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a known label, and the others."""
    return df.filter(c(label).isNotNull()), df.filter(c(label).isNull())


def drop_noise(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Rows that belong to a cluster."""
    return df.filter(c(cluster) != -1)
