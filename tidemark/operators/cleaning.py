"""Missing values, scaling, casts, and taking any of them back.

Every fit is one aggregation whose few results become literals of a plain
projection; applying a fitted step needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.features import distinct_top_freq, medians
from tidemark.operators.profile import missing
from tidemark.plans.roles import c, field_type, is_fractional, is_integer, is_numeric, is_text, require_columns

EPSILON = 2.220446049250313e-16

# Accepted names of the column types.
TYPE_NAMES = {
    "bigint": ("int", "int64", "int32", "int16", "int8", "long", "bigint"),
    "double": ("float", "float64", "float32", "float16", "double"),
    "boolean": ("bool", "boolean", "bool8"),
    "string": ("string", "str", "object", "string[python]", "string[pyarrow]", "category"),
}
# Conversions offered for each column type.
ALLOWED_CONVERSIONS = {
    "bigint": ("bigint", "double", "string"),
    "double": ("double", "bigint", "string"),
    "string": ("string",),
    "boolean": ("boolean", "string"),
}
# Words read as booleans in a custom fill value.
TRUE_WORDS = ("true", "1", "yes", "y")
FALSE_WORDS = ("false", "0", "no", "n")


def canonical_type(name: str) -> str:
    low = str(name).strip().lower()
    return next((k for k, names in TYPE_NAMES.items() if low in names), str(name))


def _present(df: DataFrame, name: str) -> Column:
    return F.when(~missing(df, name), c(name))


def fit_fill(df: DataFrame, columns: Sequence[str], method: str, values: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """Fill value of each column; None where the column has no known value."""
    columns = list(columns)
    require_columns(df, columns, "Column")
    if method == "constant":
        return {n: (values or {}).get(n) for n in columns}
    if not columns:
        return {}
    if method == "mean":
        row = df.agg(*[F.avg(_present(df, n)).alias(f"_{i}") for i, n in enumerate(columns)]).first()
        return {n: row[i] for i, n in enumerate(columns)}
    if method == "median":
        found = {r["signal"]: r["median"] for r in medians(df, columns).collect()}  # one row per column
        return {n: found.get(n) for n in columns}
    if method == "mode":
        found = {r["signal"]: r for r in distinct_top_freq(df, columns).collect()}  # one row per column
        out = {}
        for n in columns:
            r = found.get(n)
            top = None if r is None else (r["top_num"] if is_numeric(df, n) else r["top_txt"])
            out[n] = int(top) if top is not None and is_integer(df, n) else top
        return out
    raise ValueError(f"Unsupported method: {method}")


def apply_fill(df: DataFrame, fills: Mapping[str, Any]) -> DataFrame:
    """Replace missing cells; a fractional fill turns an integer column into doubles."""
    made = {}
    for n, v in fills.items():
        if v is None:
            continue
        x = _present(df, n)
        if isinstance(v, str) and not is_text(df, n):
            x = x.cast("string")
        elif isinstance(v, float) and is_integer(df, n):
            x = x.cast("double")
        fill = F.lit(v)
        made[n] = F.coalesce(x, fill if isinstance(v, (str, float)) and not is_fractional(df, n) else fill.cast(field_type(df, n)))
    return df.withColumns(made) if made else df


def fill_missing(df: DataFrame, column: str, method: str, value: Any = None) -> DataFrame:
    """Fill one column with its mean, median, smallest mode, or a constant."""
    if column not in df.columns:
        raise ValueError(f"Column does not exist: {column}")
    method = method.lower()
    fills = fit_fill(df, [column], method, {column: value})
    if method == "mode" and fills[column] is None:
        raise ValueError(f"No mode exists for column '{column}'.")
    return apply_fill(df, fills)


def parse_fill(text: str, df: DataFrame, column: str) -> Any:
    """Custom fill text in the column's own type, or the text itself if it does not fit."""
    try:
        if is_integer(df, column):
            return int(text)
        if is_fractional(df, column):
            return float(text)
        if field_type(df, column).simpleString() == "boolean":
            low = text.strip().lower()
            if low in TRUE_WORDS or low in FALSE_WORDS:
                return low in TRUE_WORDS
    except ValueError:
        pass
    return text


def fit_impute(
    df: DataFrame, columns: Sequence[str], method: str = "mean", custom: Mapping[str, str] | None = None
) -> tuple[dict[str, Any], dict[str, str]]:
    """Typed fill values of the columns that will really change, and why others are skipped."""
    columns = list(columns)
    require_columns(df, columns, "Columns")
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(missing(df, n)).alias(f"_{i}") for i, n in enumerate(columns)]
    ).first()
    gaps = {n: counts[i + 1] for i, n in enumerate(columns)}
    skipped: dict[str, str] = {}
    if method == "custom":
        fills = {}
        for n in columns:
            text = (custom or {}).get(n, "")
            if text == "":
                skipped[n] = "Custom imputation value cannot be empty."
            else:
                fills[n] = parse_fill(str(text), df, n)
        # a text fill changes the type of the whole column even when nothing is missing
        return {n: v for n, v in fills.items() if gaps[n] or (isinstance(v, str) and not is_text(df, n))}, skipped
    eligible = []
    for n in columns:
        if gaps[n] == counts["rows"]:
            skipped[n] = "contains only missing values"
        elif method in ("mean", "median") and not is_numeric(df, n):
            skipped[n] = f"{method} imputation is not valid for type {field_type(df, n).simpleString()}"
        elif gaps[n]:
            eligible.append(n)
    fills = fit_fill(df, eligible, method)
    for n, v in fills.items():
        if v is not None and is_integer(df, n):
            fills[n] = round(v)  # half to even
        elif v is not None and field_type(df, n).simpleString() == "boolean":
            fills[n] = str(v).lower() == "true"
    return {n: v for n, v in fills.items() if v is not None}, skipped


def impute(
    df: DataFrame, columns: Sequence[str], method: str = "mean", custom: Mapping[str, str] | None = None
) -> tuple[DataFrame, list[str]]:
    """Impute several columns; also returns the columns that changed."""
    fills, _ = fit_impute(df, columns, method, custom)
    return apply_fill(df, fills), list(fills)


def fit_standardize(df: DataFrame, columns: Sequence[str], with_mean: bool = True, with_std: bool = True) -> dict[str, tuple[float, float]]:
    """Centre and scale per column from the population deviation; a constant column has scale 1."""
    columns = [n for n in columns if is_numeric(df, n)]
    if not columns:
        return {}
    cells = []
    for i, n in enumerate(columns):
        x = _present(df, n).cast("double")
        cells += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}")]
    row = df.agg(*cells).first()
    out = {}
    for i, name in enumerate(columns):
        n, mean, var = row[f"n{i}"], row[f"m{i}"], row[f"v{i}"]
        if not n:
            continue
        flat = var <= n * EPSILON * var + (n * mean * EPSILON) ** 2
        out[name] = (mean if with_mean else 0.0, 1.0 if flat or not with_std else var**0.5)
    return out


def fit_normalize(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Minimum and span per column; a constant column has span 1 and becomes 0."""
    columns = [n for n in columns if is_numeric(df, n)]
    if not columns:
        return {}
    cells = []
    for i, n in enumerate(columns):
        x = _present(df, n).cast("double")
        cells += [F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")]
    row = df.agg(*cells).first()
    return {
        n: (row[f"a{i}"], (row[f"b{i}"] - row[f"a{i}"]) or 1.0) for i, n in enumerate(columns) if row[f"a{i}"] is not None
    }


def apply_scale(df: DataFrame, fitted: Mapping[str, tuple[float, float]]) -> DataFrame:
    """(x - shift) / scale with fitted literals; missing stays missing."""
    if not fitted:
        return df
    return df.withColumns(
        {n: (_present(df, n).cast("double") - F.lit(float(a))) / F.lit(float(b)) for n, (a, b) in fitted.items()}
    )


def standardize(df: DataFrame, columns: Sequence[str], with_mean: bool = True, with_std: bool = True) -> DataFrame:
    return apply_scale(df, fit_standardize(df, columns, with_mean, with_std))


def normalize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return apply_scale(df, fit_normalize(df, columns))


def try_convert(x: Column, source: str, target: str) -> Column:
    """Value in the target type, NULL where it does not fit."""
    kind = canonical_type(target)
    if kind == "bigint" and source in ("double", "float"):
        return F.when(x == F.floor(x), x).try_cast("bigint")
    if kind == "bigint" and source == "string":
        # text such as "2.0" is a whole number too
        d = F.trim(x).try_cast("double")
        return F.coalesce(F.trim(x).try_cast("bigint"), F.when(d == F.floor(d), d).try_cast("bigint"))
    if kind == "boolean" and source == "string":
        return F.when(x == "True", True).when(x == "False", False).otherwise(F.when(F.lower(x) == "true", True).when(F.lower(x) == "false", False))
    if kind == "string" and source == "boolean":
        return F.initcap(x.cast("string"))
    return x.try_cast(kind)


def can_convert(df: DataFrame, column: str, target: str) -> bool:
    """Whether every known value fits the target type (one aggregation)."""
    x = _present(df, column)
    good = try_convert(x, field_type(df, column).simpleString(), target)
    return df.agg(F.count_if(x.isNotNull() & good.isNull()).alias("bad")).first()["bad"] == 0


def cast_column(df: DataFrame, column: str, target: str, coerce: bool = False, fraction: str = "abort") -> DataFrame:
    """Cast a column. Values that do not fit are an error, or NULL with ``coerce``.

    ``fraction`` says what happens to fractional values on the way to
    integers: ``ceil``, ``floor`` or ``abort``.
    """
    require_columns(df, [column], "Column")
    kind, source = canonical_type(target), field_type(df, column).simpleString()
    x = _present(df, column)
    if kind == "bigint" and is_fractional(df, column) and fraction in ("ceil", "floor"):
        return df.withColumn(column, (F.ceil(x) if fraction == "ceil" else F.floor(x)).cast("bigint"))
    if not coerce and not can_convert(df, column, target):
        raise ValueError(f"Column '{column}' cannot be converted to {target}.")
    return df.withColumn(column, try_convert(x, source, target))


def _beside_raw(working: DataFrame, raw: DataFrame, columns: Sequence[str], row_id: str) -> tuple[DataFrame, dict[str, Column]]:
    both = [n for n in columns if n in raw.columns and n in working.columns]
    side = raw.select(c(row_id).alias("_rid"), *[c(n).alias(f"_raw{i}") for i, n in enumerate(both)])
    joined = working.join(side, c(row_id) == F.col("_rid"), "left")
    return joined, {n: F.col(f"_raw{i}") for i, n in enumerate(both)}


def revert_imputation(working: DataFrame, raw: DataFrame, columns: Sequence[str], row_id: str) -> DataFrame:
    """Cells that were missing in the raw table are missing again."""
    joined, old = _beside_raw(working, raw, columns, row_id)
    return joined.withColumns({n: F.when(o.isNotNull(), c(n)) for n, o in old.items()}).select(*[c(n) for n in working.columns])


def revert_cast(working: DataFrame, raw: DataFrame, columns: Sequence[str], row_id: str, coerce: bool = False) -> DataFrame:
    """Original type and values back; imputed cells keep their value in the original type."""
    joined, old = _beside_raw(working, raw, columns, row_id)
    made = {}
    for n, o in old.items():
        if field_type(working, n) == field_type(raw, n):
            continue
        back = try_convert(c(n), field_type(working, n).simpleString(), field_type(raw, n).simpleString())
        if not coerce and joined.filter(o.isNull() & c(n).isNotNull() & back.isNull()).limit(1).count():
            raise ValueError(f"Column '{n}' contains values that cannot be converted back.")
        made[n] = F.coalesce(o, back)
    return (joined.withColumns(made) if made else joined).select(*[c(n) for n in working.columns])


def revert_transform(working: DataFrame, raw: DataFrame, columns: Sequence[str], row_id: str) -> DataFrame:
    """Original values back, imputed cells kept, in the current type where possible."""
    joined, old = _beside_raw(working, raw, columns, row_id)
    made = {}
    for n, o in old.items():
        now, was = field_type(working, n), field_type(raw, n)
        narrower = now.simpleString() == "bigint" and was.simpleString() == "double"
        made[n] = F.coalesce(o, c(n).cast(was)) if narrower else F.coalesce(o.cast(now), c(n))
    return joined.withColumns(made).select(*[c(n) for n in working.columns])


def reselect_columns(working: DataFrame, raw: DataFrame, columns: Sequence[str], row_id: str) -> DataFrame:
    """Selected columns: prepared ones stay, others come back from the raw table by row id."""
    wanted = [n for n in columns if n != row_id]
    require_columns(raw, [n for n in wanted if n not in working.columns])
    absent = [n for n in wanted if n not in working.columns]
    kept = working.select(c(row_id), *[c(n) for n in wanted if n in working.columns])
    if absent:
        kept = kept.join(raw.select(c(row_id), *[c(n) for n in absent]), row_id, "left")
    return kept.select(c(row_id), *[c(n) for n in wanted])


def add_raw_columns(working: DataFrame, raw: DataFrame, columns: Sequence[str], row_id: str) -> DataFrame:
    """Add columns from the raw table; unknown names are ignored."""
    extra = [n for n in columns if n in raw.columns and n not in working.columns]
    return working.join(raw.select(c(row_id), *[c(n) for n in extra]), row_id, "left") if extra else working


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop columns; unknown names are ignored."""
    return df.drop(*[n for n in columns if n in df.columns])


def infinite_to_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Plus and minus infinity become missing."""
    return df.withColumns({n: F.when(F.abs(c(n)) != float("inf"), c(n)) for n in columns if is_fractional(df, n)})


def append_rows(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both tables under the union of their columns."""
    return existing.unionByName(new, allowMissingColumns=True)
