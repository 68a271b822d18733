"""Pipelines from names to names: saved and read again, folds, hold-outs, metrics and written results."""

import json
import math
import random
from collections import Counter

import pytest
from pyspark.ml import Estimator, PipelineModel
from pyspark.sql import functions as F

from motionlake import registry
from motionlake.learning import stages, training

SCHEMA = "video_id long, activity string, a double, b double, c float, note string"


def made(n=90, seed=0):
    rng = random.Random(seed)
    kinds = ["walk", "run", "stand"]
    rows = []
    for i in range(n):
        k = rng.choices(range(3), [4, 2, 2])[0]
        rows.append((i, kinds[k], rng.gauss(k, 0.5), None if i % 11 == 0 else rng.gauss(-k, 0.6), float("nan") if i % 13 == 0 else 1.0, "x"))
    return rows


def table(spark, rows=None):
    return spark.createDataFrame(made() if rows is None else rows, SCHEMA)


@pytest.mark.parametrize("name, how", [("exact_tree", {"max_depth": 3}), ("random_forest_custom", {"n_trees": 5, "max_depth": 3}), ("lightgbm", {"n_estimators": 3, "num_leaves": 4}), ("xgboost", {"n_estimators": 2, "max_depth": 3}), ("svm_rbf", {"C": 10, "gamma": "scale"}), ("knn", {"n_neighbors": 5}), ("random_forest_sklearn", {"n_estimators": 10})])
def test_a_saved_pipeline_says_the_same(spark, tmp_path, name, how):
    rows = table(spark)
    model = stages.pipeline(name, ["a", "b", "c", "gone"], "activity", "video_id", seed=1, **how).fit(rows)
    model.write().save(str(tmp_path / name))
    again = PipelineModel.load(str(tmp_path / name))
    new = table(spark, made(40, 9)).drop("activity", "c")  # neither class nor all features
    cols = ("video_id", "predicted", "probability")
    one, two = ({r["video_id"]: r for r in m.transform(new).select(*cols).collect()} for m in (model, again))
    assert len(one) == 40 and all(one[i]["predicted"] == two[i]["predicted"] and one[i]["probability"] == pytest.approx(two[i]["probability"]) for i in one)
    assert all(len(r["probability"]) == 3 and sum(r["probability"]) == pytest.approx(1, abs=1e-6) for r in one.values())
    truth = {r[0]: r[1] for r in made(40, 9)}
    assert sum(r["predicted"] == truth[i] for i, r in one.items()) >= 24
    assert registry.is_registered("model", name)


def test_matrix_codes_and_scales(spark):
    rows = table(spark)
    model = stages.pipeline("exact_tree", ["a", "c"], "activity", "video_id", max_depth=1).fit(rows)
    out = model.transform(rows.unionByName(spark.createDataFrame([(500, "swim", 1.0, 1.0, 1.0, "")], SCHEMA))).collect()
    want = [r[2] for r in made()]
    mean = sum(want) / len(want)
    sd = math.sqrt(sum((v - mean) ** 2 for v in want) / len(want))
    by = {r["video_id"]: r for r in out}
    assert by[5]["scaled"][0] == pytest.approx((want[5] - mean) / sd) and by[13]["features"][1] == 0.0
    assert by[500]["label"] is None and {r["activity"]: r["label"] for r in out if r["video_id"] < 90} == {"run": 0, "stand": 1, "walk": 2}
    counts = Counter(r[1] for r in made())
    assert by[5]["weight"] == pytest.approx(90 / (3 * counts[by[5]["activity"]]))


def plain_scores(pairs):
    classes, n = {t for t, _ in pairs}, len(pairs)
    out = [sum(t == p for t, p in pairs) / n, 0.0, 0.0, 0.0]
    for c in classes:
        hit, called, support = sum(t == p == c for t, p in pairs), sum(p == c for _, p in pairs), sum(t == c for t, _ in pairs)
        precision, recall = hit / called if called else 0.0, hit / support
        f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
        for i, v in enumerate((precision, recall, f1)):
            out[i + 1] += v * support / n
    return out


def test_metrics_by_group(spark):
    rng = random.Random(2)
    rows = [("t", m, rng.randrange(3), rng.random() < 0.5, i, rng.choice("abc"), rng.choice(["a", "b", None])) for m in ("x", "y") for i in range(60)]
    df = spark.createDataFrame(rows, "target string, model string, fold int, held_out boolean, id long, truth string, predicted string")
    for r in training.metrics(df, ["model", "fold"]).collect():
        want = plain_scores([(t, p) for _, m, f, _, _, t, p in rows if (m, f) == (r["model"], r["fold"])])
        assert [r[c] for c in ("accuracy", "precision", "recall", "f1")] == pytest.approx(want)
    for r in training.cv_summary(df).collect():
        acc = {h: [plain_scores([(t, p) for _, m, f, o, _, t, p in rows if (m, f, o) == (r["model"], k, h)])[0] for k in range(3)] for h in (True, False)}
        mean = lambda v: sum(v) / len(v)
        assert r["cv_accuracy_mean"] == pytest.approx(mean(acc[True])) and r["overfit_gap"] == pytest.approx(mean(acc[False]) - mean(acc[True]))
        assert r["cv_accuracy_std"] == pytest.approx(math.sqrt(mean([(v - mean(acc[True])) ** 2 for v in acc[True]])))
    assert sum(r["n"] for r in training.confusion(df).collect()) == sum(r[3] for r in rows)


def test_train_and_evaluate(spark, tmp_path):
    rows = table(spark)
    models = [{"name": "exact_tree", "params": {"max_depth": 2}}, "knn", {"name": "knn", "params": {"no such": 1}}, "no such model"]
    got = training.train_and_evaluate(rows, "activity", models[:2] + models[3:], training={"cv_folds": 3}, smoothing={"enabled": True, "method": "majority_vote"}, out=str(tmp_path))
    assert got["feature_keys"] == ["a", "b", "c"] and got["models"]["no such model"]["error"]
    held = got["predictions"].where("held_out and model = 'exact_tree'").collect()
    assert sorted(r["id"] for r in held) == list(range(90))
    assert got["models"]["exact_tree"]["cv_accuracy_from_predict"] == pytest.approx(sum(r["truth"] == r["predicted"] for r in held) / 90)
    assert got["models"]["exact_tree"]["cv_accuracy_mean"] > 0.6 and got["models"]["__smoothed__"]["cv_f1_from_predict"] > 0.5
    said = json.loads(spark.read.text(str(tmp_path / "results_activity")).first()[0])
    assert said["models"]["knn"] == got["models"]["knn"]
    assert spark.read.parquet(str(tmp_path / "predictions_activity")).count() == got["predictions"].count()
    assert spark.read.json(str(tmp_path / "confusion_activity")).where("model = 'knn'").agg(F.sum("n")).first()[0] == 90
    ranked = spark.read.json(str(tmp_path / "feature_importance_activity/exact_tree")).orderBy("place").collect()
    assert [r["place"] for r in ranked] == [1, 2, 3] and sum(r["importance"] for r in ranked) == pytest.approx(1)
    assert PipelineModel.load(str(tmp_path / "knn_activity")).transform(rows).count() == 90


def test_hold_outs(spark):
    rows = table(spark)
    got = training.train_and_evaluate(rows, "activity", ["exact_tree"], training={"use_cv": False, "test_size": 0.2})
    held = got["predictions"].where("held_out").groupBy("truth").count().collect()
    counts = Counter(r[1] for r in made())
    assert {r["truth"]: r["count"] for r in held} == {k: math.ceil(0.2 * n) for k, n in counts.items()}
    lone = rows.where("activity <> 'run'").unionByName(rows.where("activity = 'run'").limit(1))
    assert 0 < training.split(lone, "activity", "video_id", 0.3).where("held_out").count() < lone.count()
    few = rows.limit(3)
    assert training.validation_split(few, "activity", "video_id").where("held_out").count() == 0
    assert training.validation_split(rows, "activity", "video_id").where("held_out").count() > 0
    assert training.train_and_evaluate(lone, "activity", ["knn"]) == {"viable": False, "error": "rare classes"}
    assert training.train_and_evaluate(rows.where("false"), "activity", ["knn"]) == {"viable": False, "error": "no samples"}


def test_listed_models_work_alone(spark, sf_dir):
    """A model that ``components`` lists is an estimator; the stages of saved pipelines are registered but told apart."""
    from motionlake.plans import catalog

    listed = {r["name"] for r in catalog.QUERIES["components"](spark, sf_dir).where("category = 'model'").collect()}
    assert listed and all(isinstance(registry.build("model", n), Estimator) for n in listed)
    assert listed | set(stages.build_stages) == set(registry.available("model")) and not listed & set(stages.build_stages)
