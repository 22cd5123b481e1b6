"""Saving and loading models and whole projects as folders of parquet, Spark models and JSON."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    LinearSVCModel,
    LogisticRegressionModel,
    RandomForestClassificationModel,
)
from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.models import ClassifierModel, KernelMap
from tidemark.operators.prepare import Preparation
from tidemark.operators.recipe import Dataset

_LOADERS = {
    "decision_tree": (DecisionTreeClassificationModel, RandomForestClassificationModel),
    "random_forest": (RandomForestClassificationModel,),
    "logistic_regression": (LogisticRegressionModel,),
}
FORMAT = 1


def _write_json(spark: SparkSession, path: str, value: Mapping[str, Any]) -> None:
    # one row, one file: written through Spark so that any file system works
    spark.createDataFrame([(json.dumps(value, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_json(spark: SparkSession, path: str) -> dict[str, Any]:
    return json.loads("\n".join(r["value"] for r in spark.read.text(path).collect()))


def unique_name(name: str, existing: Iterable[str]) -> str:
    """The name, or the name with the first free number."""
    taken = set(existing)
    if name not in taken:
        return name
    number = 1
    while f"{name}_{number}" in taken:
        number += 1
    return f"{name}_{number}"


def save_model(model: ClassifierModel, path: str) -> str:
    """One folder with the fitted stages and ``metadata`` that travels with them."""
    if not model.stages and model.train is None:
        raise ValueError(f"Model '{model.name}' has no fitted estimator.")
    spark = SparkSession.active()
    scales = []
    for i, stage in enumerate(model.stages):
        machine = stage[0] if isinstance(stage, tuple) else stage
        machine.write().overwrite().save(f"{path}/stage_{i}")
        scales.append(list(stage[1]) if isinstance(stage, tuple) else None)
    if model.train is not None:
        model.train.write.mode("overwrite").parquet(f"{path}/train")
    kernel = vars(model.kernel) if model.kernel else None
    meta = {
        "format": FORMAT, "display_name": model.name, "category": model.category, "algorithm": model.algorithm, "label": model.label,
        "label_type": model.label_type, "classes": model.classes, "parameters": model.parameters, "metrics": model.metrics,
        "feature_columns": model.features, "evaluation": model.evaluation, "preparation": model.preparation.to_dict(), "kernel": kernel,
        "stages": scales, "stage_classes": [type(s[0] if isinstance(s, tuple) else s).__name__ for s in model.stages], "train": model.train is not None,
    }
    _write_json(spark, f"{path}/metadata", meta)
    return path


def model_metadata(spark: SparkSession, path: str) -> dict[str, Any]:
    """What is known of a saved model, with defaults for what older folders lack."""
    meta = _read_json(spark, f"{path}/metadata")
    meta.setdefault("category", "supervised")
    meta.setdefault("evaluation", {})
    meta.setdefault("metrics", {})
    meta.setdefault("parameters", {})
    meta.setdefault("display_name", meta.get("name", meta.get("algorithm", "model")))
    return meta


def load_model(spark: SparkSession, path: str, existing: Iterable[str] = ()) -> ClassifierModel:
    """Load a saved model; its name is made unique among ``existing``."""
    meta = model_metadata(spark, path)
    if not meta.get("stages") and not meta.get("train"):
        raise ValueError(f"The folder '{path}' holds no fitted estimator.")
    made = ClassifierModel(
        unique_name(meta["display_name"], existing), meta["algorithm"], meta["label"], meta["label_type"], meta["classes"],
        Preparation.from_dict(meta["preparation"]), meta["parameters"], metrics=meta["metrics"], category=meta["category"], evaluation=meta["evaluation"],
    )
    for i, scale in enumerate(meta["stages"]):
        if made.algorithm == "svm":
            made.stages.append((LinearSVCModel.load(f"{path}/stage_{i}"), tuple(scale)))
        else:
            loader = next(k for k in _LOADERS[made.algorithm] if k.__name__ == meta["stage_classes"][i])
            made.stages.append(loader.load(f"{path}/stage_{i}"))
    if meta.get("kernel"):
        made.kernel = KernelMap(**meta["kernel"])
    if meta.get("train"):
        made.train = spark.read.parquet(f"{path}/train")
    return made


def save_project(
    path: str,
    dataset: Dataset,
    label: str | None = None,
    features: DataFrame | None = None,
    models: Iterable[ClassifierModel] = (),
    name: str = "project",
    queue: Iterable[Mapping[str, Any]] = (),
    extra: Mapping[str, Any] | None = None,
) -> str:
    """Manifest, raw and working tables, feature table and models in one folder.

    The recipe is stored, so the working table can be rebuilt; it is stored as
    well so that readers need not replay it.
    """
    spark = dataset.raw.sparkSession
    dataset.raw.write.mode("overwrite").parquet(f"{path}/raw")
    working = dataset.working()
    working.write.mode("overwrite").parquet(f"{path}/working")
    if features is not None:
        features.toDF(*[f"f{i}" for i in range(len(features.columns))]).write.mode("overwrite").parquet(f"{path}/features")
    names = []
    for model in models:
        names.append(unique_name(model.name, names))
        save_model(model, f"{path}/models/{len(names) - 1}")
    manifest = {
        "format": FORMAT, "project_name": name, "row_id": dataset.row_id, "label_column": label, "selected_columns": working.columns,
        "column_types": {f.name: f.dataType.simpleString() for f in working.schema}, "recipe": dataset.recipe(), "models": names,
        "model_queue": [dict(q) for q in queue], "feature_columns": features.columns if features is not None else None, **(extra or {}),
    }
    _write_json(spark, f"{path}/manifest", manifest)
    return path


def load_project(spark: SparkSession, path: str) -> dict[str, Any]:
    """The project of a folder: manifest, data set with its recipe, stored tables and models."""
    manifest = _read_json(spark, f"{path}/manifest")
    data = Dataset(spark.read.parquet(f"{path}/raw"), manifest["row_id"]).replay(manifest.get("recipe", []))
    features = None
    if manifest.get("feature_columns"):
        features = spark.read.parquet(f"{path}/features").toDF(*manifest["feature_columns"])
    models = [load_model(spark, f"{path}/models/{i}") for i in range(len(manifest.get("models", [])))]
    return {"manifest": manifest, "dataset": data, "working": spark.read.parquet(f"{path}/working"), "features": features, "models": models}
