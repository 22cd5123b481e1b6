"""Feature matrices: fills, one-hot columns, scaling, alignment, label checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.cleaning import apply_fill, apply_scale, fit_fill, fit_standardize
from tidemark.plans.roles import c, is_numeric, is_text, require_columns

MISSING_CATEGORY = "__missing__"
MAX_CATEGORIES = 10_000  # a wider one-hot matrix is refused rather than cut


def check_training_table(df: DataFrame, label: str) -> None:
    """Refuse an empty table, an unknown label column and missing labels (one aggregation)."""
    if label not in df.columns:
        raise ValueError("Label column does not exist.")
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(c(label).isNull()).alias("m")).first()
    if row["n"] == 0:
        raise ValueError("Dataset is empty.")
    if row["m"]:
        raise ValueError("Label column contains missing values.")


@dataclass(frozen=True)
class Preparation:
    """Fitted preparation of raw feature columns; plain values, so it can be stored as JSON."""

    features: tuple[str, ...]
    fills: Mapping[str, Any]
    categories: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    scaling: Mapping[str, tuple[float, float]] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        """Columns of the matrix: plain features first, then one per category."""
        plain = [n for n in self.features if n not in self.categories]
        return plain + [f"{n}_{v}" for n in self.features if n in self.categories for v in self.categories[n]]

    def _matrix(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """``_keep0 …`` and ``_f0 …``: one projection, whatever names the table has."""
        require_columns(df, self.features, "Feature columns")
        held = df.select(*[c(n).alias(f"_keep{i}") for i, n in enumerate(keep)], *[c(n) for n in self.features])
        filled = apply_fill(held, {n: v for n, v in self.fills.items() if n not in self.categories})
        cells = []
        for n in self.features:
            if n not in self.categories:
                cells.append(c(n).cast("double"))
        for n in self.features:
            if n in self.categories:
                text = F.coalesce(c(n).cast("string"), F.lit(MISSING_CATEGORY))
                cells += [(text == v).cast("double") for v in self.categories[n]]
        made = filled.select(*[F.col(f"_keep{i}") for i in range(len(keep))], *[x.alias(f"_f{i}") for i, x in enumerate(cells)])
        names = {n: f"_f{i}" for i, n in enumerate(self.columns)}
        return apply_scale(made, {names[n]: v for n, v in self.scaling.items()})

    def apply(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Matrix columns (as doubles) next to the ``keep`` columns."""
        made = self._matrix(df, keep)
        return made.toDF(*keep, *self.columns)

    def vectors(self, df: DataFrame, keep: Sequence[str] = (), name: str = "features") -> DataFrame:
        """The matrix as one vector column; missing or non-finite cells are an error."""
        made = self._matrix(df, keep)
        cells = [f"_f{i}" for i in range(len(self.columns))]
        out = VectorAssembler(inputCols=cells, outputCol="_vector", handleInvalid="error").transform(made)
        return out.select(*[F.col(f"_keep{i}") for i in range(len(keep))], "_vector").toDF(*keep, name)

    def to_dict(self) -> dict[str, Any]:
        return {
            "features": list(self.features),
            "fills": dict(self.fills),
            "categories": {k: list(v) for k, v in self.categories.items()},
            "scaling": {k: list(v) for k, v in self.scaling.items()},
        }

    @staticmethod
    def from_dict(d: Mapping[str, Any]) -> "Preparation":
        return Preparation(
            tuple(d["features"]),
            dict(d["fills"]),
            {k: tuple(v) for k, v in d["categories"].items()},
            {k: tuple(v) for k, v in d["scaling"].items()},
        )


def fit_preparation(
    df: DataFrame, features: Sequence[str], fill_method: str | None = "median", fill_value: Any = None, scale: bool = False
) -> Preparation:
    """Fill values, sorted categories and optional scaling, fitted on the whole input."""
    if features is None:
        raise ValueError("features must be provided.")
    features = list(features)
    require_columns(df, features, "Feature columns")
    numeric = [n for n in features if is_numeric(df, n)]
    texts = [n for n in features if is_text(df, n)]
    odd = [n for n in features if n not in numeric and n not in texts and not isinstance(df.schema[n].dataType, T.BooleanType)]
    if odd:
        raise ValueError(f"Columns of this type cannot be used as features: {odd}")
    if fill_method in ("median", "mean", "mode"):
        fills = fit_fill(df, numeric, fill_method)
    elif fill_method == "constant":
        if fill_value is None:
            raise ValueError("A constant fill needs fill_value.")
        fills = {n: fill_value for n in numeric}
    elif fill_method in (None, "none"):
        fills = {}
    else:
        raise ValueError(f"Unsupported fill_method: {fill_method}")
    # a fractional fill may not be rounded into an integer column
    fills = {n: float(v) for n, v in fills.items() if v is not None}
    categories = {}
    for n in texts:
        text = F.coalesce(c(n), F.lit(MISSING_CATEGORY)).alias("v")
        rows = df.select(text).distinct().limit(MAX_CATEGORIES + 1).collect()
        if len(rows) > MAX_CATEGORIES:
            raise ValueError(f"Column '{n}' has more than {MAX_CATEGORIES} categories.")
        categories[n] = tuple(sorted(r["v"] for r in rows))
    made = Preparation(tuple(features), fills, categories)
    if scale:
        matrix = made.apply(df)
        made = Preparation(made.features, fills, categories, fit_standardize(matrix, matrix.columns))
    return made


def align_columns(df: DataFrame, expected: Sequence[str], keep: Sequence[str] = (), fill: float = 0.0) -> DataFrame:
    """Training columns in training order: absent ones hold ``fill``, others are dropped."""
    cells = [c(n).alias(n) if n in df.columns else F.lit(fill).alias(n) for n in expected]
    return df.select(*[c(n) for n in keep], *cells)


def vector_from_array(df: DataFrame, array_col: str, name: str = "features") -> DataFrame:
    """Vector column from an array of numbers."""
    return df.withColumn(name, array_to_vector(c(array_col).cast("array<double>")))
