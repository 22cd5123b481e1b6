"""Statistic keys, their labels, and the formulas that turn moments into them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Key -> column label of the windowed feature table.
KEY_LABELS = {
    "mean": "Mean",
    "median": "Median",
    "std": "Standard Deviation",
    "variance": "Variance",
    "min": "Min",
    "max": "Max",
    "range": "Range",
    "skew": "Skewness",
    "kurtosis": "Kurtosis",
    "rms": "RMS",
    "energy": "Energy",
    "p2p": "Peak-to-Peak",
    "zcr": "Zero Crossing Rate",
    "unique": "Unique",
    "top": "Top",
    "freq": "Frequency",
    "missing_count": "Missing Count",
    "missing_pct": "Missing Percentage",
}
MISSING_KEYS = ("missing_count", "missing_pct")
VALUE_KEYS = ("median", "unique", "top", "freq")
WHOLE_COLUMN_KEYS = ("count", *KEY_LABELS)
# Relative size under which a second moment counts as rounding noise.
NEAR_CONSTANT = 1e-15


def key_label(key: str) -> str:
    return KEY_LABELS.get(key, key)


def sign_bit(x: Column) -> Column:
    """True for negative numbers and for minus zero; NULL stays NULL."""
    return (x < 0) | ((x == 0) & (x.cast("string") == "-0.0"))


def finite(x: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def from_moments(key: str, rows: Column, n: Column, part) -> Column:
    """Value of ``key`` from a column's counts and central moment sums.

    ``part(name)`` gives the column holding mean, m2, m3, m4, min, max, sumsq
    or changes. A column without values gives NULL, except for the counts.
    """
    some = n > 0
    flat = (part("m2") / n) <= F.pow(F.lit(NEAR_CONSTANT) * part("mean"), F.lit(2.0)) if key in ("skew", "kurtosis") else None
    if key == "count":
        return n
    if key == "missing_count":
        return rows - n
    if key == "missing_pct":
        return F.when(rows > 0, (rows - n) / rows * 100.0).otherwise(F.lit(0.0))
    if key in ("mean", "min", "max"):
        return part(key)
    if key in ("range", "p2p"):
        return part("max") - part("min")
    if key == "std":
        return F.when(n > 1, F.sqrt(part("m2") / (n - 1))).when(some, F.lit(0.0))
    if key == "variance":
        return F.when(some, part("m2") / n)
    if key == "skew":
        return F.when((n <= 2) & some, F.lit(0.0)).when(
            some, F.when(flat, F.lit(0.0)).otherwise(F.sqrt(n.cast("double")) * part("m3") / F.pow(part("m2"), F.lit(1.5)))
        )
    if key == "kurtosis":
        return F.when((n <= 3) & some, F.lit(0.0)).when(
            some, F.when(flat, F.lit(0.0)).otherwise(n * part("m4") / (part("m2") * part("m2")) - 3.0)
        )
    if key == "rms":
        return F.when(some, F.sqrt(part("sumsq") / n))
    if key == "energy":
        return F.when(some, part("sumsq"))
    if key == "zcr":
        return F.when(n >= 2, part("changes") / (n - 1)).when(some, F.lit(0.0))
    raise ValueError(f"Unknown statistic key: {key}")


# Moment columns each key needs.
KEY_PARTS = {
    "count": (),
    "missing_count": (),
    "missing_pct": (),
    "mean": ("mean",),
    "min": ("min",),
    "max": ("max",),
    "range": ("min", "max"),
    "p2p": ("min", "max"),
    "std": ("mean", "m2"),
    "variance": ("mean", "m2"),
    "skew": ("mean", "m2", "m3"),
    "kurtosis": ("mean", "m2", "m3", "m4"),
    "rms": ("sumsq",),
    "energy": ("sumsq",),
    "zcr": ("changes",),
}


def parts_needed(keys) -> list[str]:
    """Moment columns for ``keys``, in a fixed order, with what merging them needs."""
    wanted = {p for k in keys for p in KEY_PARTS.get(k, ())}
    return [p for p in ("mean", "m2", "m3", "m4", "min", "max", "sumsq", "changes") if p in wanted]


def moment_aggregates(x: Column, parts, prefix: str) -> list[Column]:
    """Aggregates giving the moment sums of ``x`` (all but ``changes``)."""
    n = F.count(x)
    m2 = F.var_pop(x) * n
    made = {
        "mean": F.avg(x),
        "m2": m2,
        "m3": F.when(n > 0, F.coalesce(F.skewness(x) * F.pow(m2, F.lit(1.5)) / F.sqrt(n.cast("double")), F.lit(0.0))),
        "m4": F.when(n > 0, F.coalesce((F.kurtosis(x) + 3.0) * m2 * m2 / n, F.lit(0.0))),
        "min": F.min(x),
        "max": F.max(x),
        "sumsq": F.sum(x * x),
    }
    return [made[p].alias(f"{prefix}_{p}") for p in parts if p in made]
