"""Column roles: which columns are numeric, text, dates, or look like a time."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def c(name: str) -> Column:
    """Column by its exact name, also when it holds dots or blanks."""
    return F.col(quoted(name))


def field_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(df: DataFrame, name: str) -> bool:
    """Booleans are not numeric unless they are cast."""
    return isinstance(field_type(df, name), T.NumericType)


def is_integer(df: DataFrame, name: str) -> bool:
    return isinstance(field_type(df, name), T.IntegralType)


def is_fractional(df: DataFrame, name: str) -> bool:
    return isinstance(field_type(df, name), (T.FloatType, T.DoubleType))


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(field_type(df, name), (T.StringType, T.VarcharType, T.CharType))


def is_datetime(df: DataFrame, name: str) -> bool:
    return isinstance(field_type(df, name), (T.TimestampType, T.TimestampNTZType, T.DateType))


def numeric_columns(df: DataFrame, label: str | None = None, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude) | {label}
    return [f.name for f in df.schema if f.name not in skip and is_numeric(df, f.name)]


def text_columns(df: DataFrame, label: str | None = None, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude) | {label}
    return [f.name for f in df.schema if f.name not in skip and is_text(df, f.name)]


def non_numeric_columns(df: DataFrame, label: str | None = None, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude) | {label}
    return [f.name for f in df.schema if f.name not in skip and not is_numeric(df, f.name)]


def require_columns(df: DataFrame, names: Iterable[str], what: str = "Columns") -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} not found: {missing}")


def guess_time_column(df: DataFrame) -> str | None:
    """First column whose name mentions a time."""
    return next((n for n in df.columns if "time" in n.lower()), None)


# Exact names by which a column announces its role.
ROLE_NAMES = {
    "timestamp": ("timestamp", "time"),
    "label": ("predicted_label", "label", "true_label"),
    "confidence": ("confidence",),
}


def guess_roles(df: DataFrame) -> dict[str, str | None]:
    """Column for each role, matched on the lower-cased exact name."""
    by_name = {n.lower(): n for n in reversed(df.columns)}
    return {
        role: next((by_name[n] for n in names if n in by_name), None)
        for role, names in ROLE_NAMES.items()
    }


def nan_to_null(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """NaN counts as missing; one projection turns it into NULL."""
    names = [n for n in (columns or df.columns) if is_fractional(df, n)]
    if not names:
        return df
    return df.withColumns({quoted_name: F.when(~F.isnan(c(quoted_name)), c(quoted_name)) for quoted_name in names})
