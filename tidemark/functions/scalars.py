"""Scalar column functions."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Name fragments that announce the unit of a numeric time column.
UNIT_TOKENS = (
    (("nanosecond", "_ns", " ns"), 1e9),
    (("microsecond", "_us", " us"), 1e6),
    (("millisecond", "_ms", " ms"), 1e3),
)
# Magnitudes from which an unnamed number is read in a finer unit.
UNIT_MAGNITUDES = ((1e17, 1e9), (1e14, 1e6), (1e11, 1e3))
# Seconds per duration unit in text.
DURATION_UNITS = {
    "d": 86400.0, "day": 86400.0, "days": 86400.0, "h": 3600.0, "hour": 3600.0, "hours": 3600.0,
    "min": 60.0, "m": 60.0, "minute": 60.0, "minutes": 60.0, "s": 1.0, "sec": 1.0, "second": 1.0, "seconds": 1.0,
    "ms": 1e-3, "us": 1e-6, "ns": 1e-9,
}
_CLOCK = r"^([+-]?)(?:(\d+) days?,? ?)?(\d+):(\d{1,2}):(\d{1,2}(?:\.\d+)?)$"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _number_to_seconds(x: Column, name: str) -> Column:
    lower = name.lower()
    for tokens, per_second in UNIT_TOKENS:
        if any(t in lower for t in tokens):
            return x / per_second
    out = None
    for at_least, per_second in UNIT_MAGNITUDES:
        hit = F.abs(x) >= at_least
        out = F.when(hit, x / per_second) if out is None else out.when(hit, x / per_second)
    return out.otherwise(x)


def _text_to_seconds(x: Column) -> Column:
    t = F.trim(x)
    part = lambda i: F.regexp_extract(t, _CLOCK, i)
    clock = F.coalesce(part(2).try_cast("double"), F.lit(0.0)) * 86400.0 + part(3).try_cast("double") * 3600.0
    clock = clock + part(4).try_cast("double") * 60.0 + part(5).try_cast("double")
    clock = F.when(part(1) == "-", -clock).otherwise(clock)
    units = "|".join(sorted(DURATION_UNITS, key=len, reverse=True))
    worded = rf"^([+-]?\d+(?:\.\d+)?) ?({units})$"
    per_unit = F.create_map(*[F.lit(v) for kv in DURATION_UNITS.items() for v in kv])
    amount = F.regexp_extract(t, worded, 1).try_cast("double") * F.try_element_at(per_unit, F.regexp_extract(t, worded, 2))
    stamp = F.unix_micros(F.try_to_timestamp(t).cast("timestamp")) / 1e6
    return (
        F.when(t.rlike(_NUMBER), t.try_cast("double") / 1e9)  # a bare number is a count of nanoseconds
        .when(t.rlike(_CLOCK), clock)
        .when(t.rlike(worded), amount)
        .otherwise(stamp)
    )


def to_seconds(x: Column, name: str, data_type: T.DataType) -> Column:
    """Seconds from a duration, a timestamp, a number (unit by name, else size) or text."""
    if isinstance(data_type, T.DayTimeIntervalType):
        zero = F.lit("1970-01-01 00:00:00").cast("timestamp")
        return F.unix_micros(zero + x) / 1e6 - F.unix_micros(zero) / 1e6
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(x.cast("timestamp")) / 1e6
    if isinstance(data_type, T.NumericType):
        d = x.cast("double")
        return _number_to_seconds(F.when(~F.isnan(d), d), name)
    if isinstance(data_type, T.StringType):
        return _text_to_seconds(x)
    return F.lit(None).cast("double")


_INTEGER = r"^[+-]?\d+(_\d+)*$"
_FLOAT = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)$"


def coerced_kind(x: Column) -> Column:
    """What a raw packet value is: boolean, null, long, double or string."""
    low = F.lower(x)
    return (
        F.when(low.isin("true", "false"), "boolean")
        .when(low.isin("null", "none") | x.isNull(), "null")
        .when(x.rlike(_INTEGER), "long")
        .when(x.rlike(_FLOAT), "double")
        .otherwise("string")
    )


def coerce_value(x: Column, target: str) -> Column:
    """Raw packet value in a declared type; null, none and what does not fit give NULL."""
    low = F.lower(x)
    value = F.when(~low.isin("null", "none"), x)
    kind = target.lower()
    if kind in ("bool", "boolean"):
        return F.when(low == "true", True).when(low == "false", False)
    if kind in ("int", "bigint", "long"):
        return F.when(value.rlike(_INTEGER), F.replace(value, F.lit("_"), F.lit("")).try_cast("bigint"))
    if kind in ("float", "double"):
        return F.when(value.rlike(_INTEGER) | value.rlike(_FLOAT), F.replace(value, F.lit("_"), F.lit("")).try_cast("double"))
    if kind == "string":
        return value
    return value.try_cast(target)


def confidence(probability: Column) -> Column:
    """Highest class probability of a probability vector."""
    return F.array_max(vector_to_array(probability))
