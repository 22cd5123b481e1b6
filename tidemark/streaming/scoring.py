"""Scoring of live samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.models import ClassifierModel
from tidemark.plans.roles import is_numeric


def score_stream(samples: DataFrame, model: ClassifierModel, prediction: str = "predicted_label", confidence: str = "confidence") -> DataFrame:
    """Label and confidence of every sample of a stream: a projection without state.

    Samples with a missing feature get no label. Neighbour models need the
    training table and score per micro-batch instead (``score_batch``).
    """
    if model.algorithm == "knn":
        raise ValueError("Neighbour models score per micro-batch.")
    absent = [n for n in model.features if n not in samples.columns]
    if absent:
        raise ValueError("Missing model features: " + ", ".join(absent))
    text = [n for n in model.features if not is_numeric(samples, n)]
    if text:
        raise ValueError("These model features are not numeric: " + ", ".join(text))
    complete = F.lit(True)
    for n in model.features:
        complete = complete & F.col(f"`{n}`").isNotNull()
    # incomplete samples are filled for the projection and lose their label afterwards
    held = samples.withColumn("_complete", complete)
    filled = held.withColumns({f"_raw{i}": F.col(f"`{n}`") for i, n in enumerate(model.features)})
    filled = filled.withColumns({n: F.coalesce(F.col(f"`{n}`"), F.lit(0)) for n in model.features})
    scored = model.scores(filled, filled.columns)
    scored = scored.withColumns({n: F.col(f"_raw{i}") for i, n in enumerate(model.features)})
    ok = F.col("_complete")
    return scored.select(
        *[F.col(f"`{n}`") for n in samples.columns],
        F.when(ok, F.col("prediction").cast("string")).alias(prediction),
        F.when(ok, F.col("confidence")).alias(confidence),
    )


def score_batch(samples: DataFrame, model: ClassifierModel, row_id: str) -> DataFrame:
    """Score one micro-batch, for use inside ``foreachBatch``; works for every model."""
    return model.transform(samples, row_id)
