"""Classifiers: build, split, fit, predict, evaluate, queue."""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.evaluate import classification_metrics, confusion_matrix
from tidemark.operators.neighbours import knn_classify
from tidemark.operators.prepare import Preparation, check_training_table, fit_preparation
from tidemark.plans.metric import matrix
from tidemark.plans.roles import c, field_type, require_columns
from tidemark.plans.sampling import class_counts, hash_key, hash_rank_group
from tidemark.plans.session import materialise

ALGORITHMS = ("svm", "knn", "decision_tree", "random_forest", "logistic_regression")
MAX_TREE_DEPTH = 30  # the deepest tree the tree learner accepts
LANDMARKS = 256  # rows a kernel is approximated with, unless "landmarks" is given
TREE_BINS, SVM_PASSES = 64, 200  # unless "max_bins" and "max_iter" are given

# Default parameters of each algorithm.
DEFAULTS: dict[str, dict[str, Any]] = {
    "svm": {"C": 1.0, "kernel": "rbf", "probability": True, "gamma": "scale", "degree": 3, "coef0": 0.0, "tol": 0.001},
    "knn": {"n_neighbors": 5, "weights": "uniform", "p": 2},
    "decision_tree": {"max_depth": 0, "criterion": "gini", "min_samples_split": 2, "min_samples_leaf": 1, "max_features": None},
    "random_forest": {
        "n_estimators": 100, "max_depth": 0, "criterion": "gini", "min_samples_split": 2, "min_samples_leaf": 1,
        "max_features": "sqrt", "bootstrap": True,
    },
    "logistic_regression": {"C": 1.0, "max_iter": 1000, "penalty": "l2", "tol": 0.0001},
}
# Default settings shared by all supervised runs.
COMMON_DEFAULTS = {"test_size": 0.3, "random_state": 42, "stratify": False}
# Parameters of self-training and clustering.
OTHER_DEFAULTS = {
    "self_training": {"base_model_name": "logistic_regression", "hide_labeled_percent": 30.0, "max_iter": 10, "criterion": "threshold", "threshold": 0.9, "k_best": 10},
    "kmeans": {"n_clusters": 3, "n_init": 10, "init": "k-means++", "max_iter": 300, "tol": 0.0001},
    "dbscan": {"eps": 0.5, "min_samples": 5, "metric": "euclidean"},
    "hierarchical": {"n_clusters": 3, "linkage": "ward", "metric": "euclidean"},
}


def train_test_split(df: DataFrame, row_id: str, test_size: float = 0.3, seed: int = 42, label: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Exact split: ceil(n * test_size) test rows, spread over the classes when ``label`` is given.

    Rows are ranked by a seeded hash of their id, so the split is the same
    under any partitioning; only the cut points are computed, no row moves.
    """
    if label is None:
        counts: dict[Any, int] = {0: df.count()}
    else:
        counts = class_counts(df, label)
    total = sum(counts.values())
    wanted = math.ceil(total * float(test_size))
    if not 0 < wanted < total:
        raise ValueError("The split leaves no rows on one side.")
    sizes = spread_exactly(counts, wanted)
    marked = hash_rank_group(df, row_id, seed, {k: [m] for k, m in sizes.items()}, label, "_after")
    return marked.filter(F.col("_after") > 0).drop("_after"), marked.filter(F.col("_after") == 0).drop("_after")


def spread_exactly(counts: Mapping[Any, int], wanted: int) -> dict[Any, int]:
    """Split ``wanted`` over classes in proportion to their size, largest remainders first."""
    total = sum(counts.values())
    exact = {k: n * wanted / total for k, n in counts.items()}
    out = {k: int(v) for k, v in exact.items()}
    rest = wanted - sum(out.values())
    for k in sorted(exact, key=lambda k: (-(exact[k] - out[k]), str(k)))[:rest]:
        out[k] += 1
    return out


def stratified_folds(df: DataFrame, row_id: str, label: str, folds: int = 3, seed: int = 42, name: str = "fold") -> DataFrame:
    """Fold number per row, class sizes equal to within one row."""
    counts = class_counts(df, label)
    cuts = {k: [(n * (i + 1)) // folds for i in range(folds - 1)] for k, n in counts.items()}
    return hash_rank_group(df, row_id, seed, cuts, label, name)


def _depth(value: Any) -> int:
    if value in (0, "0", "", None):
        return MAX_TREE_DEPTH
    if int(value) > MAX_TREE_DEPTH:
        warnings.warn(f"max_depth is limited to {MAX_TREE_DEPTH}.", stacklevel=3)
    return min(int(value), MAX_TREE_DEPTH)


def build_estimator(algorithm: str, parameters: Mapping[str, Any] | None = None, rows: int = 1, seed: int = 42):
    """Spark estimator for an algorithm; parameters without a counterpart are reported."""
    algorithm = str(algorithm).strip().lower()
    if algorithm not in ALGORITHMS:
        raise ValueError(f"Unsupported supervised model_type: {algorithm}")
    p = {**DEFAULTS[algorithm], **(parameters or {})}
    common = {"featuresCol": "features", "labelCol": "_y", "predictionCol": "_p"}
    if algorithm == "logistic_regression":
        penalty = p["penalty"].strip().lower() if isinstance(p["penalty"], str) else p["penalty"]
        mix = 0.0
        strength = 1.0 / (float(p["C"]) * max(1, rows))
        if penalty in (None, "", "none", "null"):
            strength = 0.0
        elif penalty == "l1":
            mix = 1.0
        elif penalty == "elasticnet":
            if p.get("l1_ratio") is None:
                raise ValueError("The elasticnet penalty needs l1_ratio.")
            mix = float(p["l1_ratio"])
        return LogisticRegression(
            maxIter=int(p["max_iter"]), tol=float(p["tol"]), regParam=strength, elasticNetParam=mix, standardization=False,
            probabilityCol="_prob", rawPredictionCol="_raw", **common,
        )
    if algorithm in ("decision_tree", "random_forest"):
        impurity = "gini" if p["criterion"] == "gini" else "entropy"
        if int(p["min_samples_split"]) > 2:
            warnings.warn("min_samples_split has no counterpart and is ignored; use min_samples_leaf.", stacklevel=2)
        tree = {"impurity": impurity, "maxDepth": _depth(p["max_depth"]), "minInstancesPerNode": int(p["min_samples_leaf"]), "seed": int(seed), "maxBins": int(p.get("max_bins", TREE_BINS)), "maxMemoryInMB": 512}
        subset = p["max_features"] or "all"
        if algorithm == "decision_tree" and subset == "all":
            return DecisionTreeClassifier(probabilityCol="_prob", rawPredictionCol="_raw", **tree, **common)
        trees = 1 if algorithm == "decision_tree" else int(p["n_estimators"])
        bootstrap = False if algorithm == "decision_tree" else bool(p["bootstrap"])
        return RandomForestClassifier(
            numTrees=trees, featureSubsetStrategy=subset, bootstrap=bootstrap, probabilityCol="_prob", rawPredictionCol="_raw", **tree, **common
        )
    return None  # svm and knn are fitted by this module


@dataclass
class KernelMap:
    """Feature map whose inner products approximate a kernel (Nystroem landmarks)."""

    kernel: str
    gamma: float
    degree: int
    coef0: float
    landmarks: list[list[float]] = field(default_factory=list)
    whitening: list[list[float]] = field(default_factory=list)

    def values(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.kernel == "rbf":
            square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
            return np.exp(-self.gamma * np.maximum(square, 0))
        if self.kernel == "poly":
            return (self.gamma * a @ b.T + self.coef0) ** self.degree
        return np.tanh(self.gamma * a @ b.T + self.coef0)

    def fit(self, landmarks: np.ndarray) -> "KernelMap":
        values, vectors = np.linalg.eigh(self.values(landmarks, landmarks))
        keep = values > max(values.max(), 0) * 1e-10
        self.landmarks = landmarks.tolist()
        self.whitening = (vectors[:, keep] / np.sqrt(values[keep])).tolist()
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """Replace the vector column by the mapped one, batch by batch."""
        marks, white = np.array(self.landmarks), np.array(self.whitening)
        me = KernelMap(self.kernel, self.gamma, self.degree, self.coef0)

        @F.pandas_udf("array<double>")
        def mapped(x: pd.Series) -> pd.Series:
            return pd.Series(list(me.values(matrix(x), marks) @ white))

        return df.withColumn("features", array_to_vector(mapped(vector_to_array("features"))))


@dataclass
class ClassifierModel:
    """A fitted classifier with everything needed to score raw rows."""

    name: str
    algorithm: str
    label: str
    label_type: str
    classes: list[Any]
    preparation: Preparation
    parameters: dict[str, Any]
    stages: list[Any] = field(default_factory=list)
    kernel: KernelMap | None = None
    train: DataFrame | None = None
    metrics: dict[str, Any] = field(default_factory=dict)
    category: str = "supervised"
    evaluation: dict[str, Any] = field(default_factory=dict)

    @property
    def features(self) -> list[str]:
        return list(self.preparation.features)

    def _decode(self, index: Column) -> Column:
        names = F.array(*[F.lit(v) for v in self.classes])
        return F.get(names, index.cast("int")).cast(self.label_type)

    def _margins(self, vectors: DataFrame) -> DataFrame:
        """One margin column per binary machine, then calibrated shares per class."""
        mapped = self.kernel.transform(vectors) if self.kernel else vectors
        cells = []
        for i, (machine, _) in enumerate(self.stages):
            mapped = machine.transform(mapped).withColumn(f"_m{i}", vector_to_array(f"_raw{i}")[1]).drop(f"_raw{i}", f"_p{i}")
            cells.append(F.col(f"_m{i}"))
        if len(self.classes) == 2:
            slope, shift = self.stages[0][1]
            p = 1.0 / (1.0 + F.exp(-(F.lit(slope) * cells[0] + F.lit(shift))))
            prob, index = F.array(1.0 - p, p), F.when(cells[0] > 0, 1).otherwise(0)
        else:
            shares = [1.0 / (1.0 + F.exp(-(F.lit(s) * m + F.lit(b)))) for m, (_, (s, b)) in zip(cells, self.stages)]
            total = sum(shares[1:], shares[0])
            prob = F.array(*[s / total for s in shares])
            index = F.array_position(F.array(*cells), F.array_max(F.array(*cells))).cast("int") - 1
        margins = F.array(-cells[0], cells[0]) if len(self.classes) == 2 else F.array(*cells)
        return mapped.withColumns({"_probs": prob, "_index": index, "_margins": margins})

    def score_vectors(self, vectors: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``keep`` columns with the class position ``_index`` and the class shares ``_probs``."""
        if self.algorithm == "knn":
            raise ValueError("Neighbour models score tables with a row id; use predict().")
        kept = [c(n) for n in keep]
        if self.algorithm == "svm":
            return self._margins(vectors).select(*kept, "_index", "_probs")
        scored = self.stages[0].transform(vectors)
        return scored.select(*kept, F.col("_p").cast("int").alias("_index"), vector_to_array("_prob").alias("_probs"))

    def scores(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``keep`` columns with ``prediction``, ``probability`` (per class in order) and ``confidence``."""
        scored = self.score_vectors(self.preparation.vectors(df, keep), keep)
        has = self.algorithm != "svm" or bool(self.parameters.get("probability", True))
        prob = F.col("_probs") if has else F.lit(None).cast("array<double>")
        return scored.select(
            *[c(n) for n in keep], self._decode(F.col("_index")).alias("prediction"), prob.alias("probability"), F.array_max(prob).alias("confidence")
        )

    def decision_scores(self, df: DataFrame, positive: Any, keep: Sequence[str] = ()) -> DataFrame:
        """``keep`` columns with ``score``: the probability of class ``positive``, or its margin if the model gives no probabilities."""
        if positive not in self.classes:
            raise ValueError(f"{positive!r} is none of the classes {self.classes}.")
        at = self.classes.index(positive)
        vectors = self.preparation.vectors(df, keep)
        if self.algorithm == "svm" and not self.parameters.get("probability", True):
            return self._margins(vectors).select(*[c(n) for n in keep], F.get("_margins", F.lit(at)).alias("score"))
        return self.score_vectors(vectors, keep).select(*[c(n) for n in keep], F.get("_probs", F.lit(at)).alias("score"))

    def predict(self, df: DataFrame, row_id: str) -> DataFrame:
        """(row_id, prediction, probability, confidence) of every row."""
        if self.algorithm != "knn":
            return self.scores(df, [row_id])
        found = self.neighbour_votes(self.preparation.vectors(df, [row_id]), row_id)
        return found.select(
            c(row_id), F.col("prediction").cast(self.label_type).alias("prediction"), F.lit(None).cast("array<double>").alias("probability"), "confidence"
        )

    def neighbour_votes(self, vectors: DataFrame, row_id: str) -> DataFrame:
        """(row_id, prediction, confidence) of vectors by the stored training rows."""
        asks = vectors.select(c(row_id).cast("bigint").alias("qid"), vector_to_array("features").alias("x"))
        p = self.parameters
        found = knn_classify(self.train, asks, "label", int(p["n_neighbors"]), p["weights"], float(p["p"]))
        return found.withColumnRenamed("qid", row_id)

    def transform(self, df: DataFrame, row_id: str) -> DataFrame:
        """The table with prediction and confidence beside its columns."""
        said = self.predict(df, row_id).withColumnRenamed(row_id, "_rid").drop("probability")
        return df.join(said, c(row_id) == F.col("_rid")).drop("_rid")


def encode_label(df: DataFrame, label: str, classes: Sequence[Any], name: str = "_y") -> DataFrame:
    """Class position as a double, from a small broadcast table."""
    spark = df.sparkSession
    schema = T.StructType([T.StructField("_k", field_type(df, label)), T.StructField(name, T.DoubleType())])
    table = F.broadcast(spark.createDataFrame([(v, float(i)) for i, v in enumerate(classes)], schema))  # one row per class
    return df.join(table, c(label) == F.col("_k"), "left").drop("_k")


def _fit_svm(vectors: DataFrame, n_classes: int, p: Mapping[str, Any], rows: int, seed: int, width: int, id_col: str):
    kernel = None
    if p["kernel"] != "linear":
        stats = vectors.select(vector_to_array("features").alias("x"))
        if p["gamma"] == "scale":
            flat = stats.select(F.explode("x").alias("v")).agg(F.var_pop("v").alias("v")).first()["v"]
            gamma = 1.0 / (width * flat) if flat else 1.0
        else:
            gamma = 1.0 / width if p["gamma"] == "auto" else float(p["gamma"])
        marks = vectors.select("features", hash_key(id_col, seed).alias("h")).orderBy("h").limit(int(p.get("landmarks", LANDMARKS))).collect()
        kernel = KernelMap(p["kernel"], gamma, int(p["degree"]), float(p["coef0"])).fit(np.array([r["features"].toArray() for r in marks]))
        vectors = kernel.transform(vectors)
    held = vectors.persist(StorageLevel.MEMORY_AND_DISK)
    machines = []
    try:
        for i in range(1 if n_classes == 2 else n_classes):
            target = held.withColumn("_t", F.when(F.col("_y") == (1 if n_classes == 2 else i), 1.0).otherwise(0.0))
            machine = LinearSVC(
                featuresCol="features", labelCol="_t", rawPredictionCol=f"_raw{i}", predictionCol=f"_p{i}", standardization=False,
                regParam=1.0 / (float(p["C"]) * rows), tol=float(p["tol"]), maxIter=int(p.get("max_iter", SVM_PASSES)),
            ).fit(target)
            margins = machine.transform(target).select("_t", F.array(vector_to_array(f"_raw{i}")[1]).alias("m"))
            scale = LogisticRegression(featuresCol="m", labelCol="_t", maxIter=100).fit(margins.withColumn("m", array_to_vector("m")))
            machines.append((machine, (float(scale.coefficients[0]), float(scale.intercept))))
    finally:
        held.unpersist()
    return machines, kernel


def fit_classifier(
    df: DataFrame,
    label: str,
    row_id: str,
    algorithm: str,
    parameters: Mapping[str, Any] | None = None,
    features: Sequence[str] | None = None,
    preparation: Preparation | None = None,
    fill_method: str | None = "median",
    fill_value: Any = None,
    seed: int = 42,
    name: str | None = None,
    classes: Sequence[Any] | None = None,
) -> ClassifierModel:
    """Fit a classifier on every row of ``df``."""
    algorithm = str(algorithm).strip().lower()
    if algorithm not in ALGORITHMS:
        raise ValueError(f"Unsupported supervised model_type: {algorithm}")
    features = list(features) if features is not None else [n for n in df.columns if n not in (label, row_id)]
    prep = preparation or fit_preparation(df, features, fill_method, fill_value)
    found = class_counts(df, label)
    classes = list(classes) if classes is not None else sorted(found)
    rows = sum(found.values())
    params = {**DEFAULTS[algorithm], **(parameters or {})}
    kind = field_type(df, label).simpleString()
    made = ClassifierModel(name or algorithm, algorithm, label, kind, classes, prep, params)
    coded = encode_label(prep.vectors(df, [row_id, label]), label, classes).select(c(row_id), "features", "_y")
    fit_encoded(made, coded, row_id, rows, seed)
    return made


def fit_encoded(made: ClassifierModel, coded: DataFrame, row_id: str, rows: int, seed: int = 42) -> ClassifierModel:
    """Fit ``made`` on vectors with class positions (row_id, features, _y)."""
    if made.algorithm == "knn":
        if int(made.parameters["n_neighbors"]) > rows:
            raise ValueError("n_neighbors cannot exceed the number of training rows.")
        points = coded.select(c(row_id).cast("bigint").alias("id"), vector_to_array("features").alias("x"), made._decode(F.col("_y")).alias("label"))
        made.train = materialise(points, "knn-train")
    elif made.algorithm == "svm":
        width = len(made.preparation.columns)
        made.stages, made.kernel = _fit_svm(coded, len(made.classes), made.parameters, rows, seed, width, row_id)
    else:
        estimator = build_estimator(made.algorithm, made.parameters, rows, seed)
        made.stages = [estimator.fit(coded.select("features", "_y"))]
    return made


def train_and_evaluate(
    df: DataFrame,
    label: str,
    row_id: str,
    algorithm: str,
    parameters: Mapping[str, Any] | None = None,
    features: Sequence[str] | None = None,
    test_size: float = 0.3,
    seed: int = 42,
    fill_method: str | None = "median",
    fill_value: Any = None,
    stratify: bool = False,
    fit_scope: str = "all",
    name: str | None = None,
) -> dict[str, Any]:
    """Prepare, split, fit, predict the test rows and evaluate.

    ``fit_scope`` says whether fills and categories come from all rows or from
    the training rows only.
    """
    require_columns(df, features or [], "Feature columns")
    check_training_table(df, label)
    features = list(features) if features is not None else [n for n in df.columns if n not in (label, row_id)]
    train, test = train_test_split(df, row_id, test_size, seed, label if stratify else None)
    prep = fit_preparation(df if fit_scope == "all" else train, features, fill_method, fill_value)
    classes = sorted(class_counts(df, label))
    model = fit_classifier(train, label, row_id, algorithm, parameters, features, prep, seed=seed, name=name, classes=classes)
    said = model.predict(test, row_id)
    truth = test.select(c(row_id), c(label))
    predictions = truth.join(said, row_id)
    held = predictions.persist(StorageLevel.MEMORY_AND_DISK)
    row = classification_metrics(held, label, "prediction").first()
    model.metrics = {k: row[k] for k in ("accuracy", "precision", "recall", "f1")}
    return {
        "model": model, "features": features, "metrics": model.metrics, "predictions": held,
        "confusion_matrix": confusion_matrix(held, label, "prediction"),
    }


def train_all(df: DataFrame, specs: Sequence[Mapping[str, Any]], label: str, row_id: str, parallelism: int = 1) -> tuple[dict[str, dict[str, Any]], DataFrame]:
    """Train a queue of model definitions; one failure does not stop the others.

    A spec holds name, category, algorithm, parameters and options. Threads
    only submit Spark jobs. Returns results by name (the last of equal names
    wins) and a status table.
    """
    from tidemark.operators.cluster import cluster_table
    from tidemark.operators.selftrain import self_training_workflow

    held = df.persist(StorageLevel.MEMORY_AND_DISK)

    def one(spec: Mapping[str, Any]) -> tuple[str, str, str | None, Any]:
        options = dict(spec.get("options") or {})
        try:
            if spec["category"] == "supervised":
                made = train_and_evaluate(held, label, row_id, spec["algorithm"], spec.get("parameters"), name=spec["name"], **options)
            elif spec["category"] == "unsupervised":
                made = cluster_table(held, spec["algorithm"], row_id, parameters=spec.get("parameters"), **options)
            else:
                made = self_training_workflow(held, label, row_id, parameters=spec.get("parameters"), name=spec["name"], **options)
            return spec["name"], "trained", None, made
        except Exception as error:  # noqa: BLE001 - reported in the status table
            return spec["name"], "failed", str(error).splitlines()[0], None

    try:
        with ThreadPoolExecutor(max_workers=max(1, int(parallelism))) as pool:
            done = list(pool.map(one, specs))
    finally:
        held.unpersist()
    results = {name: made for name, _, _, made in done if made is not None}
    status = df.sparkSession.createDataFrame([(n, s, e) for n, s, e, _ in done], "name string, status string, error string")
    return results, status


def _labelled_rows(model: Any, df: DataFrame, label: str) -> DataFrame:
    """The rows a model of its category is judged on: all, or for self-trained models those with a label."""
    known = df.filter(c(label).isNotNull())
    if getattr(model, "category", "supervised") == "semi_supervised":
        return known
    gaps = df.count() - known.count()
    if gaps:
        raise ValueError(f"{model.name} is judged on every row, and {gaps} rows have no {label}.")
    return df


def evaluate_models(models: Sequence[Any], df: DataFrame, label: str, row_id: str) -> list[dict[str, Any]]:
    """A report per saved model: classifiers on this table, cluster models by the metrics they were saved with."""

    def report(model: Any, **found: Any) -> dict[str, Any]:
        return {"name": getattr(model, "name", "Unnamed model"), "category": category(model), "metrics": None, "confusion_matrix": None, "predictions": None, "note": None, **found}

    def category(model: Any) -> str:
        return getattr(model, "category", "supervised")

    def classifier(model: Any) -> dict[str, Any]:
        require_columns(df, [label, *model.features], f"Columns of {model.name}")
        rows = _labelled_rows(model, df, label)
        said = rows.select(c(row_id), c(label)).join(model.predict(rows, row_id), row_id)
        scores = classification_metrics(said, label, "prediction").first().asDict()
        if scores["accuracy"] is None:
            raise ValueError(f"No row has a {label} that {model.name} could be judged on.")
        return report(model, metrics=scores, confusion_matrix=confusion_matrix(said, label, "prediction"), predictions=said)

    def clusters(model: Any) -> dict[str, Any]:
        return report(model, metrics=model.metrics, note="Cluster models keep their own metrics; there is no label to compare with.")

    return [clusters(m) if category(m) == "unsupervised" else classifier(m) for m in models]


def prediction_columns(models: Sequence[ClassifierModel], df: DataFrame, row_id: str) -> DataFrame:
    """The table with one ``{name}_prediction`` column per model."""
    out = df
    for model in models:
        said = model.predict(df, row_id).select(c(row_id).alias("_rid"), F.col("prediction").alias(f"{model.name}_prediction"))
        out = out.join(said, c(row_id) == F.col("_rid"), "left").drop("_rid")
    return out


def feature_importance(model: ClassifierModel, top: int = 15) -> DataFrame:
    """Importances of a tree model or mean absolute coefficients of a linear one, highest first."""
    spark = SparkSession.active()
    names = model.preparation.columns
    fitted = model.stages[0] if model.stages else None
    if hasattr(fitted, "featureImportances"):
        values = [float(v) for v in fitted.featureImportances.toArray()]
    elif hasattr(fitted, "coefficientMatrix"):
        values = np.abs(fitted.coefficientMatrix.toArray()).mean(0).tolist()
    elif model.algorithm == "svm" and model.kernel is None:
        values = np.abs(np.stack([m.coefficients.toArray() for m, _ in model.stages])).mean(0).tolist()
    else:
        raise ValueError("The model has neither feature importances nor coefficients.")
    order = sorted(range(len(values)), key=lambda i: -values[i])[:top]
    return spark.createDataFrame([(names[i], values[i]) for i in order], "feature string, value double")

