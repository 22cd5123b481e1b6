"""Scoring whole tables with a fitted model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.models import ClassifierModel
from tidemark.operators.profile import missing
from tidemark.plans.roles import is_numeric


def match_features(model: ClassifierModel, columns: Sequence[str]) -> tuple[list[str], list[str]]:
    """Model features the table has, and those it lacks."""
    have = set(columns)
    return [f for f in model.features if f in have], [f for f in model.features if f not in have]


def check_scoring_table(df: DataFrame, features: Sequence[str]) -> None:
    """Refuse a table that lacks features, holds them as text, or has gaps in them (one aggregation)."""
    lacking = [n for n in features if n not in df.columns]
    wordy = [n for n in features if n in df.columns and not is_numeric(df, n)]
    for text, names in (("Missing model features", lacking), ("These features are not numeric", wordy)):
        if names:
            raise ValueError(f"{text}: {', '.join(names)}")
    seen = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(missing(df, n)).alias(f"_{i}") for i, n in enumerate(features)]).first()
    if not features or not seen["rows"]:
        raise ValueError("Nothing to score: there are no rows or the model has no features.")
    gaps = ", ".join(f"{n} ({k})" for n, k in zip(features, seen[1:]) if k)
    if gaps:
        raise ValueError(f"Features with missing values: {gaps}")


def score_table(
    df: DataFrame, model: ClassifierModel, row_id: str, prediction: str = "Predicted_Label", confidence: str = "Prediction_Confidence", check: bool = True
) -> DataFrame:
    """The table with predicted label and confidence (NULL for models without probabilities).

    Models other than neighbour models are a projection over the table: no
    shuffle, no join.
    """
    if check:
        check_scoring_table(df, model.features)
    if model.algorithm == "knn":
        out = model.transform(df, row_id)
    else:
        out = model.scores(df, df.columns).drop("probability")
    return out.withColumnsRenamed({"prediction": prediction, "confidence": confidence})
