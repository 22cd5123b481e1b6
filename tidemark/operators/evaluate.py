"""Classification and clustering metrics, and diagnostic curves of binary scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.ordered import running_totals
from tidemark.plans.roles import c, field_type

CALIBRATION_BINS = 10
METRIC_NOTE = "Clustering metrics require at least 2 non-noise clusters with enough samples."


def _pair_counts(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(c(label).cast("string").alias("actual"), c(prediction).cast("string").alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 (undefined counts as 0), one row."""
    pairs = _pair_counts(df, label, prediction)
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(F.lit(0))
    cells = F.array(
        F.struct(F.col("actual").alias("k"), hit.alias("tp"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("said")),
        F.struct(F.col("predicted").alias("k"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("said")),
    )
    by_class = pairs.select(F.explode(cells).alias("x")).select("x.*").groupBy("k").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("said").alias("said")
    )
    p = F.coalesce(F.try_divide(F.col("tp"), F.col("said")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("said") + F.col("support")), F.lit(0.0))
    n = F.sum("support")
    return by_class.agg(
        (F.sum("tp") / n).alias("accuracy"),
        (F.sum(p * F.col("support")) / n).alias("precision"),
        (F.sum(r * F.col("support")) / n).alias("recall"),
        (F.sum(f1 * F.col("support")) / n).alias("f1"),
    )


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Counts of every (actual, predicted) pair of the sorted label union, zeros included."""
    pairs = _pair_counts(df, label, prediction)
    labels = pairs.select(F.explode(F.array("actual", "predicted")).alias("k")).distinct()
    every = labels.agg(F.sort_array(F.collect_set("k")).alias("ks"))  # one row of class names
    grid = every.select(F.explode("ks").alias("actual"), "ks").select("actual", F.explode("ks").alias("predicted"))
    return (
        grid.join(pairs, ["actual", "predicted"], "left")
        .select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("count"))
        .orderBy("actual", "predicted")
    )


def confusion_pivot(matrix: DataFrame) -> DataFrame:
    """The matrix as a square table."""
    return matrix.groupBy("actual").pivot("predicted").agg(F.sum("count")).orderBy("actual")


def clean_binary(df: DataFrame, label: str, score: str) -> tuple[DataFrame, str]:
    """Rows with a known label and a finite score as (positive, score), and the positive class.

    There must be exactly two labels; the last in sort order is the positive
    one. Of several score columns (a vector or an array) the last counts.
    """
    kind = field_type(df, score)
    if isinstance(kind, VectorUDT):
        value = F.element_at(vector_to_array(c(score)), -1)
    elif kind.typeName() == "array":
        value = F.element_at(c(score).cast("array<double>"), -1)
    else:
        value = c(score).cast("string").try_cast("double") if kind.typeName() == "string" else c(score).cast("double")
    rows = df.filter(c(label).isNotNull()).select(c(label).cast("string").alias("label"), value.alias("score"))
    finite = rows.filter(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf")))
    names = sorted(r["label"] for r in rows.select("label").distinct().limit(3).collect())
    kept = [r["label"] for r in finite.select("label").distinct().limit(3).collect()]
    if len(names) != 2 or len(kept) != 2:
        raise ValueError("Binary charts need exactly two labels.")
    return finite.select((F.col("label") == names[1]).cast("int").alias("positive"), "score"), names[1]


def _score_totals(binary: DataFrame) -> DataFrame:
    """Running positives and negatives per distinct score, highest first, with the totals."""
    per_score = binary.groupBy("score").agg(
        F.sum("positive").cast("bigint").alias("pos"), F.sum(1 - F.col("positive")).cast("bigint").alias("neg")
    )
    run = running_totals(per_score, ["pos", "neg"], [F.desc("score")])
    totals = per_score.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    return run.join(F.broadcast(totals), F.lit(True), "inner")  # one row


def roc_curve(binary: DataFrame) -> DataFrame:
    """Points of the receiver operating curve from (0, 0), one per distinct score."""
    run = _score_totals(binary)
    points = run.select(
        F.col("score").alias("threshold"),
        (F.col("cum_neg") / F.col("all_neg")).alias("fpr"),
        (F.col("cum_pos") / F.col("all_pos")).alias("tpr"),
    )
    start = binary.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], points.schema)
    return start.unionByName(points)


def roc_auc(binary: DataFrame) -> DataFrame:
    """Trapezoid area under the curve; each score carries the step from the one before it."""
    run = _score_totals(binary)
    step = F.col("neg") / F.col("all_neg") * (2 * F.col("cum_pos") - F.col("pos")) / F.col("all_pos") / 2
    return run.agg(F.sum(step).alias("auc"))


def _precision(pos, neg):
    return pos / (pos + neg)


def precision_recall_curve(binary: DataFrame) -> DataFrame:
    """Precision and recall per distinct score, ending in (recall 0, precision 1)."""
    run = _score_totals(binary)
    points = run.select(
        F.col("score").alias("threshold"),
        (F.col("cum_pos") / F.col("all_pos")).alias("recall"),
        _precision(F.col("cum_pos"), F.col("cum_neg")).alias("precision"),
    )
    end = binary.sparkSession.createDataFrame([(None, 0.0, 1.0)], points.schema)
    return points.unionByName(end)


def precision_recall_auc(binary: DataFrame) -> DataFrame:
    """Trapezoid area under precision over recall."""
    run = _score_totals(binary)
    before_pos, before_neg = F.col("cum_pos") - F.col("pos"), F.col("cum_neg") - F.col("neg")
    before = F.coalesce(F.try_divide(before_pos, before_pos + before_neg), F.lit(1.0))
    here = _precision(F.col("cum_pos"), F.col("cum_neg"))
    return run.agg(F.sum(F.col("pos") / F.col("all_pos") * (here + before) / 2).alias("auc"))


def calibration_curve(binary: DataFrame, bins: int = CALIBRATION_BINS) -> DataFrame:
    """Mean score and share of positives per score bin (lower, upper]; empty bins are left out."""
    edges = F.array(*[F.lit(i * (1.0 / bins)) for i in range(1, bins)])
    number = F.size(F.filter(edges, lambda e: e < F.col("score")))
    return (
        binary.groupBy(number.cast("bigint").alias("bin"))
        .agg(F.avg("score").alias("mean_predicted"), F.avg("positive").alias("fraction_positive"), F.count(F.lit(1)).alias("count"))
        .orderBy("bin")
    )


def cluster_summary(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Size of each cluster with its description."""
    return (
        df.groupBy(c(cluster).alias("cluster")).agg(F.count(F.lit(1)).alias("count"))
        .withColumn("description", F.when(F.col("cluster") == -1, "Noise").otherwise(F.concat(F.lit("Cluster "), F.col("cluster").cast("string"))))
        .orderBy("cluster")
    )


def _shares(counts: DataFrame) -> DataFrame:
    total = counts.agg(F.sum("count").alias("_all"))
    return counts.join(F.broadcast(total), F.lit(True), "inner").withColumn(
        "percentage", F.col("count") / F.greatest(F.lit(1), F.col("_all")) * 100.0
    ).drop("_all")


def cluster_shares(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Share of each cluster; noise first, then by number."""
    return _shares(cluster_summary(df, cluster)).orderBy("cluster").select("cluster", "count", "percentage")


def label_source_shares(df: DataFrame, source: str) -> DataFrame:
    """Share of original, pseudo-labelled and remaining rows."""
    # Display names of the label sources.
    shown = {"original": "Original", "pseudo_labeled": "Pseudo-labeled", "remaining_unlabeled": "Remaining unlabeled"}
    name = c(source)
    for key, text in shown.items():
        name = F.when(c(source) == key, text).otherwise(name)
    counts = df.groupBy(name.alias("source")).agg(F.count(F.lit(1)).alias("count"))
    return _shares(counts).orderBy(F.desc("count"), "source")


# Columns of the comparison table and the metric each one shows.
COMPARISON_METRICS = {
    "accuracy": "accuracy",
    "precision": "precision",
    "recall": "recall",
    "f1": "f1",
    "silhouette": "silhouette_score",
    "davies_bouldin": "davies_bouldin_score",
    "calinski_harabasz": "calinski_harabasz_score",
}
COMPARISON_COUNTS = {"clusters": "cluster_count", "noise": "noise_count"}
COMPARISON_PROGRESS = {
    "originally_unlabeled": "Originally unlabeled",
    "pseudo_labeled": "Pseudo-labeled",
    "remaining_unlabeled": "Remaining unlabeled",
}


def comparison_table(spark, records: Sequence[Mapping[str, Any]]) -> DataFrame:
    """One row per model: identity, metrics to four decimals (blank if absent), counts, extra metrics."""
    known = set(COMPARISON_METRICS.values()) | set(COMPARISON_COUNTS.values()) | {"note"}
    extra: list[str] = []
    for rec in records:
        for key, value in (rec.get("metrics") or {}).items():
            if key not in known and value is not None and key not in extra:
                extra.append(key)

    def four(v):
        return round(float(v), 4) if isinstance(v, (int, float)) and not isinstance(v, bool) else None

    rows = []
    for rec in records:
        metrics = rec.get("metrics") or {}
        progress = {str(p.get("status", "")): p.get("count") for p in (rec.get("evaluation") or {}).get("ssl_progress") or []}
        row = [rec.get("name", ""), rec.get("label") or "N/A", rec.get("source", "project"), rec.get("category", ""), rec.get("algorithm", "")]
        row += [four(metrics.get(m)) for m in COMPARISON_METRICS.values()]
        row += [metrics.get(m) for m in COMPARISON_COUNTS.values()]
        row += [progress.get(s) for s in COMPARISON_PROGRESS.values()]
        row += [four(metrics.get(m)) for m in extra]
        rows.append(tuple(row))
    fields = ["name string", "label string", "source string", "category string", "algorithm string"]
    fields += [f"{n} double" for n in COMPARISON_METRICS]
    fields += [f"{n} long" for n in [*COMPARISON_COUNTS, *COMPARISON_PROGRESS]]
    fields += [f"`{n}` double" for n in extra]
    return spark.createDataFrame(rows, ", ".join(fields))


def metric_list(spark, records: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Finite numeric metrics in long form; cluster metrics do not apply to self-training."""
    cluster_only = {"silhouette_score", "davies_bouldin_score", "calinski_harabasz_score", "cluster_count", "noise_count"}
    rows = []
    for rec in records:
        for key, value in (rec.get("metrics") or {}).items():
            number = isinstance(value, (int, float)) and not isinstance(value, bool) and abs(float(value)) != float("inf") and value == value
            if number and not (rec.get("category") == "semi_supervised" and key in cluster_only):
                rows.append((rec.get("name", ""), rec.get("category", ""), key, float(value)))
    return spark.createDataFrame(rows, "name string, category string, metric string, value double")


def same_kind(records: Sequence[Mapping[str, Any]], category: str) -> None:
    """Refuse to compare models of different categories."""
    if any(rec.get("category") != category for rec in records):
        raise ValueError(f"Only {category} models can be compared here.")
