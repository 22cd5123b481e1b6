"""Accuracy over training size, over a parameter, and over the number of neighbours."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.models import fit_classifier, stratified_folds
from tidemark.operators.neighbours import accuracy_by_k
from tidemark.operators.prepare import fit_preparation
from tidemark.plans.roles import c
from tidemark.plans.sampling import class_counts, hash_rank_group

FOLDS = 3
# Shares of the training rows of a learning curve.
LEARNING_SHARES = (0.2, 0.4, 0.6, 0.8, 1.0)
# Parameter and values of each algorithm's validation curve.
VALIDATION_GRIDS: dict[str, tuple[str, list[Any]]] = {
    "svm": ("C", [0.1, 0.5, 1.0, 5.0, 10.0]),
    "knn": ("n_neighbors", [1, 3, 5, 7, 9, 11]),
    "decision_tree": ("max_depth", [2, 4, 6, 8, 10]),
    "random_forest": ("n_estimators", [20, 50, 100, 200]),
    "logistic_regression": ("C", [0.1, 0.5, 1.0, 5.0, 10.0]),
}


def _accuracy(model, df: DataFrame, label: str, row_id: str) -> float:
    said = model.predict(df, row_id).join(df.select(c(row_id), c(label)), row_id)
    return said.agg(F.avg((F.col("prediction") == c(label)).cast("double")).alias("a")).first()["a"]


def _folds(df: DataFrame, label: str, row_id: str, seed: int) -> DataFrame:
    return stratified_folds(df, row_id, label, FOLDS, seed).persist(StorageLevel.MEMORY_AND_DISK)


def learning_curve(
    df: DataFrame, label: str, row_id: str, algorithm: str, parameters: Mapping[str, Any] | None = None, features: Sequence[str] | None = None, seed: int = 42
) -> DataFrame:
    """Mean training and validation accuracy of three folds for five training sizes."""
    counts = class_counts(df, label)
    if sum(counts.values()) < 20:
        raise ValueError("A learning curve needs at least 20 rows.")
    features = list(features) if features is not None else [n for n in df.columns if n not in (label, row_id)]
    prep = fit_preparation(df, features)
    folds, scores = _folds(df, label, row_id, seed), {}
    for f in range(FOLDS):
        train, test = folds.filter(F.col("fold") != f).drop("fold"), folds.filter(F.col("fold") == f).drop("fold")
        rows = train.count()
        sizes = [int(rows * s) for s in LEARNING_SHARES]
        ranked = hash_rank_group(train, row_id, seed + 1, {0: sizes[:-1]}, None, "_part").persist(StorageLevel.MEMORY_AND_DISK)
        for i, size in enumerate(sizes):
            part = ranked.filter(F.col("_part") <= i).drop("_part")
            model = fit_classifier(part, label, row_id, algorithm, parameters, features, prep, seed=seed, classes=sorted(counts))
            scores.setdefault(i, []).append((size, _accuracy(model, part, label, row_id), _accuracy(model, test, label, row_id)))
        ranked.unpersist()
    folds.unpersist()
    rows = [(v[0][0], sum(s[1] for s in v) / FOLDS, sum(s[2] for s in v) / FOLDS) for v in scores.values()]
    return df.sparkSession.createDataFrame(rows, "training_rows long, train_accuracy double, validation_accuracy double")


def validation_curve(
    df: DataFrame, label: str, row_id: str, algorithm: str, parameters: Mapping[str, Any] | None = None, features: Sequence[str] | None = None, seed: int = 42,
    grid: tuple[str, Sequence[Any]] | None = None,
) -> DataFrame:
    """Mean training and validation accuracy of three folds over the algorithm's parameter grid."""
    name, values = grid or VALIDATION_GRIDS[algorithm]
    features = list(features) if features is not None else [n for n in df.columns if n not in (label, row_id)]
    prep = fit_preparation(df, features)
    classes = sorted(class_counts(df, label))
    folds, rows = _folds(df, label, row_id, seed), []
    for value in values:
        train_score = test_score = 0.0
        for f in range(FOLDS):
            train, test = folds.filter(F.col("fold") != f).drop("fold"), folds.filter(F.col("fold") == f).drop("fold")
            model = fit_classifier(train, label, row_id, algorithm, {**(parameters or {}), name: value}, features, prep, seed=seed, classes=classes)
            train_score += _accuracy(model, train, label, row_id) / FOLDS
            test_score += _accuracy(model, test, label, row_id) / FOLDS
        rows.append((name, str(value), train_score, test_score))
    folds.unpersist()
    return df.sparkSession.createDataFrame(rows, "parameter string, value string, train_accuracy double, validation_accuracy double")


def accuracy_over_k(points: DataFrame, label: str, id_col: str = "id", vector: str = "x", seed: int = 42) -> DataFrame:
    """Cross-validated accuracy for k = 1 up to a fifth of the rows (at least 3, at most 20)."""
    rows = sum(class_counts(points, label).values())
    if rows < 20:
        raise ValueError("This curve needs at least 20 rows.")
    most = min(20, max(3, rows // 5))
    return accuracy_by_k(stratified_folds(points, id_col, label, FOLDS, seed), label, most, "fold", id_col, vector)
