"""Classifiers, self-training, storage and scoring on the small public tables."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import models as mo
from tidemark.operators import selftrain as st
from tidemark.operators.score import score_table
from tidemark.plans.session import shared_folder
from tidemark.sources.project import load_model, load_project, save_model, save_project, unique_name
from tidemark.operators.recipe import Dataset

FEATURES = ["score", "grade"]


@pytest.fixture(scope="module")
def table(students):
    return students.select("student", "research", *FEATURES)


@pytest.mark.parametrize("algorithm,parameters", [("logistic_regression", {}), ("random_forest", {"n_estimators": 5, "max_depth": 4}), ("svm", {}), ("knn", {})])
def test_workflow_and_storage(spark, table, algorithm, parameters):
    made = mo.train_and_evaluate(table, "research", "student", algorithm, parameters, FEATURES, stratify=True)
    assert made["metrics"]["accuracy"] > 0.6 and made["predictions"].count() == 150
    path = save_model(made["model"], f"{shared_folder(spark)}/test-model-{algorithm}-{id(made)}")
    again = load_model(spark, path, ["x", made["model"].name])
    assert again.name == f"{algorithm}_1" and again.metrics == pytest.approx(made["metrics"])
    both = made["model"].predict(table, "student").join(again.predict(table, "student").select("student", F.col("prediction").alias("p")), "student")
    assert both.filter("prediction <> p").count() == 0 and both.count() == 500


def test_split_is_independent_of_partitions(table):
    a = mo.train_test_split(table, "student")[1].select("student")
    b = mo.train_test_split(table.repartition(23), "student")[1].select("student")
    assert a.count() == 150 and a.exceptAll(b).count() == 0


def test_refusals(table):
    with pytest.raises(ValueError, match="missing values"):
        mo.train_and_evaluate(table.withColumn("research", F.when(F.col("student") > 3, F.col("research"))), "research", "student", "knn")
    with pytest.raises(ValueError, match="Label column"):
        mo.train_and_evaluate(table, "nothing", "student", "knn", features=FEATURES)
    with pytest.raises(ValueError, match="l1_ratio"):
        mo.build_estimator("logistic_regression", {"penalty": "elasticnet"}, 10)
    with pytest.raises(ValueError, match="Unsupported"):
        mo.build_estimator("boosting")
    model = mo.fit_classifier(table, "research", "student", "decision_tree", {"max_depth": 2}, FEATURES)
    with pytest.raises(ValueError, match=r"missing values: grade \(1\)"):
        score_table(table.withColumn("grade", F.when(F.col("student") != 5, F.col("grade"))), model, "student")
    with pytest.raises(ValueError, match="Missing model features: grade"):
        score_table(table.drop("grade"), model, "student")
    with pytest.raises(ValueError, match="not numeric"):
        score_table(table.withColumn("grade", F.lit("x")), model, "student")
    plan = score_table(table, model, "student", check=False)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_hidden_labels_and_holdout(table):
    hidden = st.hide_labels(table, "research", "student", 40)
    before = {r[0]: r[1] for r in table.groupBy("research").count().collect()}
    after = {r[0]: r[1] for r in hidden.filter("research IS NOT NULL").groupBy("research").count().collect()}
    assert after == {k: n - int(n * 0.4) for k, n in before.items()}
    train, test = st.labeled_holdout(hidden, "research", "student")
    assert test.count() == round(sum(after.values()) * 0.3) and train.count() + test.count() == 500
    assert st._within({"a": 2, "b": 100}, 40) == {"a": 1, "b": 39}
    with pytest.raises(ValueError, match="at least two rows"):
        one = table.filter("research = 1").agg(F.min("student")).first()[0]
        st.labeled_holdout(table.filter(f"research = 0 OR student = {one}"), "research", "student")


def test_self_training_keeps_every_row(table):
    made = st.self_training_workflow(table, "research", "student", parameters={"hide_labeled_percent": 50, "threshold": 0.8, "max_iter": 4}, features=FEATURES)
    history = made["history"].orderBy("iteration").collect()
    assert sum(r["newly_pseudo_labeled"] for r in history) == made["pseudo_labeled_count"]
    hidden = sum(int(r["count"] * 0.5) for r in table.groupBy("research").count().collect())
    assert made["pseudo_labeled_count"] + made["unlabeled_remaining"] == hidden
    out = {r[0]: r[1] for r in made["export"].groupBy("research_source").count().collect()}
    assert out["original"] == 500 - hidden and out.get("pseudo_labeled", 0) == made["pseudo_labeled_count"] and sum(out.values()) == 500


def test_self_training_from_a_fitted_model(table):
    seed = mo.fit_classifier(table, "research", "student", "logistic_regression", None, FEATURES)
    hidden = st.hide_labels(table, "research", "student", 50)
    made = st.self_train(hidden, "research", "student", FEATURES, criterion="k_best", k_best=20, max_iter=2, pretrained=seed)
    rows = made["history"].orderBy("iteration").collect()
    assert rows[0]["description"] == "Pretrained model seed" and [r["newly_pseudo_labeled"] for r in rows] == [20, 20]
    assert made["stopped"] == "max_iter"


def test_pretrained_model_guesses_only_classes_of_the_table(table):
    kinds = table.withColumn("kind", F.when(F.col("grade") > 9.2, "c").when(F.col("grade") > 8.4, "b").otherwise("a"))
    seed = mo.fit_classifier(kinds, "kind", "student", "logistic_regression", None, FEATURES)
    part = kinds.withColumn("kind", F.when((F.col("kind") != "c") & (F.col("student") % 2 == 0), F.col("kind")))
    made = st.self_train(part, "kind", "student", FEATURES, threshold=0.0, max_iter=1, pretrained=seed)
    labels = {r[0] for r in made["pseudo_labels"].select("label").distinct().collect()}
    assert labels <= {"a", "b"} and made["pseudo_labels"].count() == part.filter("kind IS NULL").count()
    with pytest.raises(ValueError, match="features"):
        st.self_train(part, "kind", "student", FEATURES[:1], max_iter=1, pretrained=seed)


def test_rank_cuts_agree_on_both_paths(table, monkeypatch):
    scored = table.select("student", (F.col("student") % 7 / 7.0).alias("confidence"))
    take = lambda k: {r[0] for r in scored.filter(st._accepted(scored, "k_best", 0.9, k, "student")).select("student").collect()}
    want = {k: take(k) for k in (1, 100, 499, 600)}
    monkeypatch.setattr(st, "MOST_BEST", 0)
    assert {k: take(k) for k in want} == want and len(want[100]) == 100 and len(want[600]) == 500


def test_scores_without_probabilities(table):
    model = mo.fit_classifier(table, "research", "student", "svm", {"kernel": "linear", "probability": False}, FEATURES)
    rows = model.decision_scores(table, 1, ["student"]).join(model.predict(table, "student"), "student").collect()
    assert all((r["score"] > 0) == (r["prediction"] == 1) for r in rows) and len(rows) == 500


def test_project(spark, table):
    data = Dataset(table, "student").standardize(["grade"])
    model = mo.fit_classifier(table, "research", "student", "decision_tree", {"max_depth": 2}, FEATURES)
    path = save_project(f"{shared_folder(spark)}/test-project-{id(data)}", data, "research", table.select(F.col("grade").alias("Mean Grade")), [model, model])
    got = load_project(spark, path)
    assert [m.name for m in got["models"]] == ["decision_tree", "decision_tree_1"] or len(got["models"]) == 2
    assert got["features"].columns == ["Mean Grade"] and got["manifest"]["label_column"] == "research"
    assert got["dataset"].working().exceptAll(got["working"]).count() == 0
    assert unique_name("a", ["a", "a_1"]) == "a_2"
