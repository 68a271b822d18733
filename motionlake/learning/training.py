"""A run that trains and evaluates: folds or a hold-out, metrics, confusion, importances, saved pipelines, results.

Predictions are written once as a table (target, model, fold, held_out, id, truth,
predicted); every metric is an aggregation of that table.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import learn
from ..operators.reuse import written
from ..sources import files
from . import stages

KEYS = ("target", "model")


def split(rows: DataFrame, label: str, id_col: str, share: float = 0.15, order: Column | None = None) -> DataFrame:
    """Adds held_out: ``share`` of each class, as ``learn.holdout``; where a class has one row only, or
    fewer rows are held out than there are classes, ``share`` of all rows by a hash of the id."""
    s = learn.training_viability(rows.where(F.col(label).isNotNull()), label).first()
    if s["samples"] and s["smallest"] >= 2 and s["samples"] * share >= s["classes"]:
        return learn.holdout(rows, label, id_col, share, order)
    return rows.withColumn("held_out", F.pmod(F.xxhash64(F.lit("held out"), id_col), F.lit(1_000_000)) < int(share * 1_000_000))


def validation_split(rows: DataFrame, label: str, id_col: str, share: float = 0.15) -> DataFrame:
    """Adds held_out as ``split`` does, but of fewer than four rows or two a class none is."""
    s = learn.training_viability(rows, label).first()
    if s["samples"] < max(4, 2 * s["classes"]):
        return rows.withColumn("held_out", F.lit(False))
    return split(rows, label, id_col, share)


def metrics(predictions: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per ``by``: n, accuracy, and precision, recall and F1 weighted by the classes' rows (0 where undefined)."""
    by = list(by)
    counted = predictions.groupBy(*by, "truth", "predicted").agg(F.count("*").alias("n"))
    hit = F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0))
    of_truth = counted.groupBy(*by, F.col("truth").alias("class")).agg(F.sum("n").alias("support"), hit.alias("hit"))
    called = counted.where("predicted is not null").groupBy(*by, F.col("predicted").alias("class")).agg(F.sum("n").alias("called"))
    per = of_truth.join(called, [*by, "class"], "left").withColumn("called", F.coalesce("called", F.lit(0)))
    precision = F.when(F.col("called") > 0, F.col("hit") / F.col("called")).otherwise(0.0)
    recall = F.col("hit") / F.col("support")
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    mean = lambda c: F.sum(c * F.col("support")) / F.sum("support")
    return per.groupBy(*by).agg(F.sum("support").alias("n"), (F.sum("hit") / F.sum("support")).alias("accuracy"), mean(precision).alias("precision"), mean(recall).alias("recall"), mean(f1).alias("f1"))


def confusion(predictions: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """Per ``by``, truth and predicted the number of held-out rows."""
    return predictions.where("held_out").groupBy(*by, "truth", "predicted").agg(F.count("*").alias("n"))


def cv_summary(predictions: DataFrame) -> DataFrame:
    """Per target and model: mean and population deviation over folds of held-out accuracy and F1, mean accuracy on
    training rows, the gap between the two, and accuracy and F1 over all held-out rows at once."""
    per = metrics(predictions, [*KEYS, "fold", "held_out"])
    out = lambda c, f, held=True: f(F.when(F.col("held_out") == held, F.col(c)))
    folds = per.groupBy(*KEYS).agg(
        out("accuracy", F.avg).alias("cv_accuracy_mean"), out("accuracy", F.stddev_pop).alias("cv_accuracy_std"), out("f1", F.avg).alias("cv_f1_mean"), out("f1", F.stddev_pop).alias("cv_f1_std"), out("accuracy", F.avg, False).alias("train_accuracy_mean")
    )
    whole = metrics(predictions.where("held_out"), KEYS).select(*KEYS, F.col("accuracy").alias("cv_accuracy_from_predict"), F.col("f1").alias("cv_f1_from_predict"))
    return folds.withColumn("overfit_gap", F.col("train_accuracy_mean") - F.col("cv_accuracy_mean")).join(whole, list(KEYS))


def _said(model: PipelineModel, rows: DataFrame, target: str, id_col: str, name: str, fold: int, held: Column) -> DataFrame:
    out = model.transform(rows)
    return out.select(F.lit(target).alias("target"), F.lit(name).alias("model"), F.lit(fold).alias("fold"), held.alias("held_out"), F.col(id_col).alias("id"), F.col(target).cast("string").alias("truth"), "predicted")


def predictions(rows: DataFrame, features: Sequence[str], target: str, name: str, id_col: str, folds: int = 5, order: Column | None = None, share: float | None = None, **how) -> DataFrame:
    """Predictions of a model for held-out and for training rows: fold by fold, or with ``share`` of one hold-out.

    A fold's pipeline, scaling and label codes included, is fitted to the other folds' rows;
    folds are fitted at the same time. Rows without a class are left out.
    """
    known = rows.where(F.col(target).isNotNull())
    if share is not None:
        dealt = written(split(known, target, id_col, share, order), "split")
        model = stages.pipeline(name, list(features), target, id_col, **how).fit(dealt.where("not held_out"))
        return written(_said(model, dealt, target, id_col, name, 0, F.col("held_out")), "predictions")
    dealt = written(learn.stratified_folds(known, target, id_col, folds, order), "folds")

    def one(fold: int) -> DataFrame:
        model = stages.pipeline(name, list(features), target, id_col, **how).fit(dealt.where(F.col("fold") != fold))
        return written(_said(model, dealt, target, id_col, name, fold, F.col("fold") == fold), f"fold{fold}")

    with ThreadPoolExecutor(folds) as pool:
        return reduce(DataFrame.unionByName, pool.map(one, range(folds)))


def importances(model: PipelineModel, features: Sequence[str]) -> DataFrame | None:
    """feature (name), importance, place (from 1), most important first; None for models without."""
    spark = None
    for stage in model.stages:
        if isinstance(stage, stages.GrownModel):
            spark, found = stage.data.sparkSession, stage.importances()
            if found is None:
                return None
            shares = {r["feature"]: r["importance"] for r in found.collect()}  # one row a feature
            break
        if hasattr(stage, "featureImportances"):
            shares = dict(enumerate(stage.featureImportances.toArray().tolist()))
            break
    else:
        return None
    ranked = sorted(((shares.get(i, 0.0), f) for i, f in enumerate(features)), key=lambda x: (-x[0], x[1]))
    from pyspark.sql import SparkSession

    spark = spark or SparkSession.active()
    return spark.createDataFrame([(f, float(v), i + 1) for i, (v, f) in enumerate(ranked)], "feature string, importance double, place long")


def feature_names(rows: DataFrame, leave_out: Sequence[str]) -> list[str]:
    """The numeric columns, in order of their names, but for ids, targets and what else is no feature."""
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    return sorted(c for c, t in rows.dtypes if t in numeric and c not in set(leave_out))


def train_and_evaluate(rows: DataFrame, target: str, models: Sequence[str | dict[str, Any]], id_col: str = "video_id", features: Sequence[str] | None = None, leave_out: Sequence[str] = (), training: dict[str, Any] | None = None, smoothing: dict[str, Any] | None = None, seed: int = 42, out: str | None = None) -> dict[str, Any]:
    """Train and evaluate ``models`` for one target; returns what ``results`` holds and, with ``out``, writes it.

    ``training``: use_cv, cv_folds, min_per_class, test_size. Where there are too few rows or
    classes nothing is trained and the message says why; a model that fails is reported and
    the others go on. Each model is fitted to all rows at last and saved as a pipeline
    (``out``/<model>_<target>); predictions, confusion, importances and metrics are JSON
    beside it. With two models and more and ``smoothing`` enabled their votes are a model too.
    """
    own = {"use_cv": True, "cv_folds": 5, "min_per_class": 3, "test_size": 0.15} | (training or {})
    known = rows.where(F.col(target).isNotNull())
    features = list(features) if features is not None else feature_names(rows, [id_col, target, *leave_out])
    check = learn.training_viability(known, target, own["cv_folds"], own["min_per_class"]).first()
    if not check["samples"] or check["message"] != "OK":
        return {"viable": False, "error": check["message"] if check["samples"] else "no samples"}
    known, results, said, saved = written(known, "known"), {}, [], {}
    for given in models:
        name, how = (given, {}) if isinstance(given, str) else (given["name"], given.get("params") or {})
        how = {"seed": seed} | how
        try:
            one = predictions(known, features, target, name, id_col, own["cv_folds"], None, None if own["use_cv"] else own["test_size"], **how)
            model = stages.pipeline(name, features, target, id_col, **how).fit(known)
            ranked = importances(model, features)
        except Exception as e:  # the run goes on with the other models
            results[name] = {"error": str(e).splitlines()[0] if str(e) else type(e).__name__}
            continue
        said.append(one)
        saved[name] = model, ranked
    if not said:
        return {"viable": True, "target": target, "models": results}
    every = reduce(DataFrame.unionByName, said)
    if smoothing and smoothing.get("enabled") and len(said) > 1:
        every = every.unionByName(_smoothed(every, smoothing))
    every = written(every, "predictions")
    held = metrics(every.where("held_out"), KEYS)
    summary = cv_summary(every).join(held.select(*KEYS, "precision", "recall"), list(KEYS)) if own["use_cv"] else held
    for r in summary.collect():  # one row a model
        results[r["model"]] = {k: v for k, v in r.asDict().items() if k not in KEYS}
    report = {"viable": True, "target": target, "feature_keys": features, "models": results}
    if out:
        _write(every, saved, report, target, out)
    return report | {"predictions": every, "pipelines": {n: m for n, (m, _) in saved.items()}}


def _smoothed(every: DataFrame, how: dict[str, Any]) -> DataFrame:
    """The held-out predictions of all models as votes, alike or weighted by the accuracy's place."""
    held = every.where("held_out")
    votes = held.select("fold", F.struct("fold", "id").alias("key"), "id", "truth", "model", F.col("predicted").alias("label"))
    if how.get("method") == "ema":
        accuracy = held.groupBy("model").agg(F.avg((F.col("truth") == F.col("predicted")).cast("double")).alias("accuracy"))
        weights = learn.model_weights(accuracy, how.get("ema_alpha", 0.7))
        voted = learn.vote(votes.join(F.broadcast(weights), "model"), "key", weight=F.round("weight", 9))  # one row a model
    else:
        voted = learn.vote(votes, "key")
    truth = held.select(F.struct("fold", "id").alias("key"), "target", "truth").distinct()
    return voted.join(truth, "key").select("target", F.lit("__smoothed__").alias("model"), F.col("key.fold").alias("fold"), F.lit(True).alias("held_out"), F.col("key.id").alias("id"), "truth", "predicted")


def _write(every: DataFrame, saved: dict[str, tuple], report: dict[str, Any], target: str, out: str) -> None:
    spark = every.sparkSession
    every.write.mode("overwrite").parquet(f"{out}/predictions_{target}")
    files.write_json(confusion(every), f"{out}/confusion_{target}")
    for name, (model, ranked) in saved.items():
        model.write().overwrite().save(f"{out}/{name}_{target}")
        if ranked is not None:
            files.write_json(ranked.withColumn("model", F.lit(name)), f"{out}/feature_importance_{target}/{name}")
    spark.createDataFrame([(json.dumps(report, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/results_{target}")
