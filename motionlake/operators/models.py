"""Classifiers over feature tables: Spark ML estimators, and evaluation out of fold."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import register
from . import learn
from .reuse import written


DEEPEST = 30  #: Spark allows no deeper tree; the reference has 100 for its tree and no limit for its forest.


PART_ROWS = 40_000  #: Rows of all folds for each part of the rows that a fold's model is fitted to.


@register("model", "decision_tree")
def decision_tree(seed: int = 42):
    return DecisionTreeClassifier(impurity="entropy", maxDepth=DEEPEST, seed=seed, weightCol="weight")


@register("model", "random_forest")
def random_forest(seed: int = 42, trees: int = 200):
    return RandomForestClassifier(numTrees=trees, maxDepth=DEEPEST, seed=seed, weightCol="weight", featureSubsetStrategy="sqrt")


@register("model", "boosted_trees")
def boosted_trees(seed: int = 42, rounds: int = 200):
    """One boosted binary model per class; a stand-in for multiclass gradient boosting."""
    return OneVsRest(classifier=GBTClassifier(maxIter=rounds, maxDepth=6, stepSize=0.1, seed=seed), weightCol=None)


@register("model", "linear_svm")
def linear_svm():
    """A linear stand-in for a kernel machine, one model per class."""
    return OneVsRest(classifier=LinearSVC(maxIter=50, regParam=0.01))


def prepared(rows: DataFrame, features: Sequence[str], label: str, id_col: str, keep: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """id, label (code in order of the names), features, weight (classes in balance) and ``keep``; and the
    labels' names. Rows without a label are left out, null features become 0."""
    known = rows.where(F.col(label).isNotNull()).na.fill(0.0, list(features))
    weights = learn.class_weights(known, label).select(F.col(label).alias("_label"), F.col("balanced").alias("weight"))
    ready = known.join(weights, F.col(label) == F.col("_label")).drop("_label")
    coder = StringIndexer(inputCol=label, outputCol="label_code", stringOrderType="alphabetAsc").fit(ready)
    ready = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(coder.transform(ready))
    return ready.select(F.col(id_col).alias("id"), F.col("label_code").alias("label"), "features", "weight", *keep), list(coder.labels)


def importances(rows: DataFrame, features: Sequence[str], label: str, id_col: str, model: object, k: int | None = 10) -> DataFrame:
    """feature, importance, place: the ``k`` features (all if None) that a fitted tree model weighs most; ties by name."""
    ready, _ = prepared(rows, features, label, id_col)
    found = sorted(zip(model.fit(ready).featureImportances.toArray().tolist(), features, strict=True), key=lambda x: (-x[0], x[1]))[:k]
    return rows.sparkSession.createDataFrame([(f, v, i + 1) for i, (v, f) in enumerate(found)], "feature string, importance double, place long")


def probabilities(rows: DataFrame, features: Sequence[str], label: str, id_col: str, model: object) -> DataFrame:
    """id, label, probability: of each row each class's probability by a model fitted to all rows; a
    model without probabilities gives 1.0 to its prediction."""
    ready, labels = prepared(rows, features, label, id_col)
    said = model.fit(ready).transform(ready)
    chance = vector_to_array("probability") if "probability" in said.columns else F.transform(F.sequence(F.lit(0), F.lit(len(labels) - 1)), lambda i: (i == F.col("prediction").cast("int")).cast("double"))
    return said.select("id", F.posexplode(chance).alias("code", "probability")).select("id", F.get(F.array(*map(F.lit, labels)), F.col("code")).alias("label"), "probability")


def save(model: object, labels: Sequence[str], features: Sequence[str], path: str, spark: SparkSession) -> None:
    """Write a fitted model with its labels and features; an existing one is an error."""
    model.write().save(f"{path}/model")
    spark.createDataFrame([(list(labels), list(features))], "labels array<string>, features array<string>").coalesce(1).write.json(f"{path}/names")


def load(kind: type, path: str, spark: SparkSession) -> tuple[object, list[str], list[str]]:
    """A model of that class, its labels and its features, as ``save`` wrote them."""
    names = spark.read.schema("labels array<string>, features array<string>").json(f"{path}/names").first()
    return kind.load(f"{path}/model"), names["labels"], names["features"]


def out_of_fold(rows: DataFrame, features: Sequence[str], label: str, id_col: str, model: Callable[[], object], folds: int = 5, order=None) -> DataFrame:
    """id, truth, predicted, fold: each row is predicted by a model fitted to the other folds.

    Classes weigh in balance; folds are stratified and repeatable, and fitted at the same time.
    The rows are dealt and written once. A level of a tree sends its sums from every part of the
    rows, so parts are of many rows, and their number grows with the rows only.
    """
    ready, labels = prepared(learn.stratified_folds(rows.where(F.col(label).isNotNull()), label, id_col, folds, order), features, label, id_col, ["fold"])
    ready = written(ready, "folds")
    parts = -(-ready.count() // PART_ROWS) or 1
    names = F.array(*map(F.lit, labels))
    with ThreadPoolExecutor(folds) as pool:
        fitted = list(pool.map(lambda k: model().fit(ready.where(F.col("fold") != k).coalesce(parts)), range(folds)))
    parts = [m.transform(ready.where(F.col("fold") == k)).select("id", F.get(names, F.col("label").cast("int")).alias("truth"), F.get(names, F.col("prediction").cast("int")).alias("predicted"), "fold") for k, m in enumerate(fitted)]
    return reduce(DataFrame.union, parts)


def fold_scores(predictions: DataFrame) -> DataFrame:
    """One row: mean and deviation of the accuracy over folds."""
    per = predictions.groupBy("fold").agg(F.avg((F.col("truth") == F.col("predicted")).cast("double")).alias("accuracy"))
    return learn.fold_summary(per, ["accuracy"])
