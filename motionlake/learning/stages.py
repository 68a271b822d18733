"""Stages that make a run from named features to named predictions one saved Spark ML pipeline.

FeatureMatrix, LabelCoder, Standardiser, a classifier, LabelDecoder: each is a
Transformer or an Estimator with Params, and can be written and read alone or within a
``PipelineModel``. What a classifier has learned is a table and is saved as one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCol, HasInputCols, HasLabelCol, HasOutputCol, HasPredictionCol, HasProbabilityCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import learn
from ..registry import register
from . import boosting, kernel, trees


class FeatureMatrix(Transformer, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """An array of the named features, in their order; one that is null, not a number or not there is 0."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol="features"):
        super().__init__()
        self._setDefault(outputCol="features")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        there = {c.lower() for c in dataset.columns}
        value = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) if c.lower() in there else F.lit(0.0)
        return dataset.withColumn(self.getOutputCol(), F.array(*map(value, self.getInputCols())))


class _Labels(Params):
    """The names of classes, in order; bounded by the number of classes."""

    labels = Param(Params._dummy(), "labels", "names of the classes by code", TypeConverters.toListString)
    weights = Param(Params._dummy(), "weights", "n / (k n_c) of each class", TypeConverters.toListFloat)


class LabelCoder(Estimator, HasInputCol, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the classes: the place of a name among the names in order, from 0."""

    @keyword_only
    def __init__(self, *, inputCol=None, labelCol="label"):
        super().__init__()
        self._setDefault(labelCol="label")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> LabelCoderModel:
        named = dataset.where(F.col(self.getInputCol()).isNotNull()).select(F.col(self.getInputCol()).cast("string").alias("label"))
        rows = sorted((r["label"], r["balanced"]) for r in learn.class_weights(named).collect())
        return self._copyValues(LabelCoderModel()._set(labels=[r[0] for r in rows], weights=[float(r[1]) for r in rows]))


class LabelCoderModel(Model, HasInputCol, HasLabelCol, _Labels, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the code of each row's class and, as ``weight``, the class's weight; null for unknown names and without the column."""

    def __init__(self):
        super().__init__()
        self._setDefault(labelCol="label")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        labels, weights = self.getOrDefault("labels"), self.getOrDefault("weights")
        if self.getInputCol() not in dataset.columns or not labels:
            return dataset.withColumns({self.getLabelCol(): F.lit(None).cast("int"), "weight": F.lit(None).cast("double")})
        place = F.array_position(F.array(*map(F.lit, labels)), F.col(self.getInputCol()).cast("string")).cast("int")
        code = F.when(place > 0, place - 1)
        return dataset.withColumns({self.getLabelCol(): code, "weight": F.get(F.array(*map(F.lit, weights)), code)})


class LabelDecoder(Estimator, HasInputCol, HasPredictionCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the names of classes, to give predictions their names."""

    @keyword_only
    def __init__(self, *, inputCol=None, predictionCol="prediction", outputCol="predicted"):
        super().__init__()
        self._setDefault(predictionCol="prediction", outputCol="predicted")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> LabelDecoderModel:
        labels = sorted(r[0] for r in dataset.select(F.col(self.getInputCol()).cast("string")).distinct().collect() if r[0] is not None)
        return self._copyValues(LabelDecoderModel()._set(labels=labels, weights=[]))


class LabelDecoderModel(Model, HasInputCol, HasPredictionCol, HasOutputCol, _Labels, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self):
        super().__init__()
        self._setDefault(predictionCol="prediction", outputCol="predicted")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names = F.array(*map(F.lit, self.getOrDefault("labels"))) if self.getOrDefault("labels") else F.array().cast("array<string>")
        return dataset.withColumn(self.getOutputCol(), F.get(names, F.col(self.getPredictionCol()).cast("int")))


class Standardiser(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the mean and population deviation of each component of an array."""

    @keyword_only
    def __init__(self, *, inputCol="features", outputCol="scaled"):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="scaled")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> StandardiserModel:
        long = dataset.select(F.posexplode(self.getInputCol()).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
        rows = sorted((r["i"], r["m"], r["s"]) for r in long.collect())  # one row a component
        return self._copyValues(StandardiserModel()._set(means=[r[1] for r in rows], scales=[r[2] or 1.0 for r in rows]))


class StandardiserModel(Model, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Each component less its mean, by its deviation; a constant one is 0."""

    means = Param(Params._dummy(), "means", "mean of each component", TypeConverters.toListFloat)
    scales = Param(Params._dummy(), "scales", "deviation of each component", TypeConverters.toListFloat)

    def __init__(self):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="scaled")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        of = lambda name: F.array(*map(F.lit, self.getOrDefault(name))) if self.getOrDefault(name) else F.array().cast("array<double>")
        centred = F.zip_with(self.getInputCol(), of("means"), lambda v, m: v - m)
        return dataset.withColumn(self.getOutputCol(), F.zip_with(centred, of("scales"), lambda v, s: v / s))


class VectorColumn(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """An array as a vector, for Spark's own classifiers."""

    @keyword_only
    def __init__(self, *, inputCol="scaled", outputCol="vector"):
        super().__init__()
        self._setDefault(inputCol="scaled", outputCol="vector")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), array_to_vector(self.getInputCol()))


class Unpacked(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """What Spark's own classifiers say in the form of the others: prediction int, probability array."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        said = dataset.withColumns({"prediction": F.col("_said").cast("int"), "probability": vector_to_array("_chance")})
        return said.drop("_said", "_chance", "_raw", "vector")


def _appended(dataset: DataFrame, features: str, model: object, say) -> DataFrame:
    """``dataset`` with prediction and probability from ``say(model, x)``, where the rows are; the model is bounded."""
    shared, at = dataset.sparkSession.sparkContext.broadcast(model), dataset.columns.index(features)
    schema = T.StructType([*dataset.schema.fields, T.StructField("prediction", T.IntegerType()), T.StructField("probability", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            label, chance = say(shared.value, x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(label, pa.int32()), pa.array(chance.tolist(), pa.list_(pa.float64()))], schema.names)

    return dataset.mapInArrow(run, schema)


def _boosted(model: boosting.Booster, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = boosting.softmax(model.scores(model.binned(x)))
    return p.argmax(1), p


def _kernel(model: kernel.Machine, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = model.values(x)
    return model.labels(values), model.probabilities(values)


def _voted(dataset: DataFrame, id_col: str, votes: DataFrame) -> DataFrame:
    """``dataset`` with the label of the largest share (id, label, share), of equals the smallest, and all shares."""
    classes = votes.agg((F.max("label") + 1).alias("_k"))
    best = F.min(F.struct((-F.col("share")).alias("s"), "label"))
    said = votes.groupBy(F.col("id").alias("_id")).agg(best.alias("b"), F.map_from_entries(F.collect_list(F.struct("label", "share"))).alias("_m"))
    each = F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda i: F.coalesce(F.element_at("_m", i), F.lit(0.0)))
    said = said.join(F.broadcast(classes)).select("_id", F.col("b.label").cast("int").alias("prediction"), each.alias("probability"))  # one row
    return dataset.join(said, F.col(id_col) == F.col("_id"), "left").drop("_id")


def _neighbours(rows: DataFrame, base: DataFrame, k: int) -> DataFrame:
    near = learn.nearest(rows.select("id", "features"), base, k, "id", "features")
    own = base.select(F.col("id").alias("other"), "label")
    shares = near.join(own, "other").groupBy("id", "label").agg(F.count("*").alias("n"))
    return shares.select("id", "label", (F.col("n") / k).alias("share"))


def _forest(rows: DataFrame, trees_: int = 200, max_depth: int = 100, min_split: int = 2, seed: int = 42) -> DataFrame:
    many = rows.agg(F.max(F.size("features"))).first()[0] or 1
    return trees.grow(rows, trees.bootstrap(rows, trees_, seed=seed), max(1, int(many**0.5)), max_depth, min_split, seed)


#: kind: what it learns from rows (id, label, features), as a table.
_FITS = {
    "tree": lambda rows, seed=42, **how: trees.grow(rows, None, seed=seed, **how),
    "forest": lambda rows, trees=200, **how: _forest(rows, trees, **how),
    "leaf_wise": lambda rows, seed=42, **how: boosting.fit(rows, boosting.leaf_wise(**how)).table(rows.sparkSession),
    "level_wise": lambda rows, seed=42, **how: boosting.fit(rows, boosting.level_wise(**how)).table(rows.sparkSession),
    "kernel": lambda rows, **how: kernel.fit(rows, **how).table(rows.sparkSession),
    "nearest": lambda rows, seed=42, k=5: rows,
}


class _Classifier(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol):
    """``kind`` of the method, ``how`` it is set (JSON), and the column of unique ids."""

    kind = Param(Params._dummy(), "kind", "tree, forest, leaf_wise, level_wise, kernel or nearest", TypeConverters.toString)
    how = Param(Params._dummy(), "how", "settings of the method as JSON", TypeConverters.toString)
    idCol = Param(Params._dummy(), "idCol", "column of unique ids", TypeConverters.toString)

    def _defaults(self) -> None:
        self._setDefault(featuresCol="scaled", labelCol="label", how="{}", idCol="id")

    def settings(self) -> dict:
        return json.loads(self.getOrDefault("how"))


class GrownClassifier(Estimator, _Classifier, DefaultParamsReadable, DefaultParamsWritable):
    """Fits the method ``kind`` to the rows that have a label."""

    @keyword_only
    def __init__(self, *, kind=None, how="{}", idCol="id", featuresCol="scaled", labelCol="label"):
        super().__init__()
        self._defaults()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> GrownModel:
        rows = dataset.where(F.col(self.getLabelCol()).isNotNull()).select(F.col(self.getOrDefault("idCol")).alias("id"), F.col(self.getLabelCol()).alias("label"), F.col(self.getFeaturesCol()).alias("features"))
        model = GrownModel()
        model.data = _FITS[self.getOrDefault("kind")](rows, **self.settings())
        return self._copyValues(model)


class _TableWriter(MLWriter):
    def __init__(self, instance: GrownModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.data.write.parquet(f"{path}/data")


class _TableReader(MLReader):
    def load(self, path: str) -> GrownModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = GrownModel()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.data = self.sparkSession.read.parquet(f"{path}/data")
        return model


class GrownModel(Model, _Classifier, MLWritable, MLReadable):
    """Adds prediction (code of the class) and probability (share of each class) to rows; ``data`` is what was learned."""

    def __init__(self):
        super().__init__()
        self._defaults()
        self.data: DataFrame | None = None
        self._held: object = None

    def copy(self, extra=None):
        out = super().copy(extra)
        out.data, out._held = self.data, self._held
        return out

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader()

    def _transform(self, dataset: DataFrame) -> DataFrame:
        kind, id_col, features = self.getOrDefault("kind"), self.getOrDefault("idCol"), self.getFeaturesCol()
        if kind in ("leaf_wise", "level_wise", "kernel"):
            self._held = self._held or (kernel.Machine if kind == "kernel" else boosting.Booster).read(self.data)
            return _appended(dataset, features, self._held, _kernel if kind == "kernel" else _boosted)
        rows = dataset.select(F.col(id_col).alias("id"), F.col(features).alias("features"))
        votes = _neighbours(rows, self.data, self.settings().get("k", 5)) if kind == "nearest" else trees.votes(rows, self.data)
        return _voted(dataset, id_col, votes)

    def importances(self) -> DataFrame | None:
        """feature (number), importance: shares of splits; None for methods without."""
        kind = self.getOrDefault("kind")
        if kind in ("tree", "forest"):
            return trees.importances(self.data)
        if kind in ("leaf_wise", "level_wise"):
            split = self.data.where("round >= 0 and feature >= 0")
            return trees.importances(split.select("feature"))
        return None


def classifier(name: str, id_col: str = "id", **how) -> list:
    """The stages of a classifier by its registered name."""
    return build_stages[name](id_col, how)


def _grown(kind: str, rename: dict[str, str] | None = None, drop: tuple[str, ...] = (), seeded: bool = True):
    def stages(id_col: str, how: dict) -> list:
        own = {(rename or {}).get(k, k): v for k, v in how.items() if k not in drop and v is not None}
        if not seeded:
            own.pop("seed", None)
        return [GrownClassifier(kind=kind, how=json.dumps(own, sort_keys=True), idCol=id_col)]

    return stages


def _mllib_forest(id_col: str, how: dict) -> list:
    forest = RandomForestClassifier(numTrees=how.get("n_estimators", 200), maxDepth=how.get("max_depth") or 30, seed=how.get("seed", 42), weightCol="weight", featureSubsetStrategy="sqrt", featuresCol="vector", labelCol="label", predictionCol="_said", probabilityCol="_chance", rawPredictionCol="_raw")
    return [VectorColumn(), forest, Unpacked()]


#: Names and settings as configurations have them.
_BOOST = {"n_estimators": "rounds", "max_depth": "depth", "learning_rate": "rate", "num_leaves": "leaves", "class_weight": "weight"}
build_stages = {
    "exact_tree": _grown("tree", {"min_samples_split": "min_split"}, ("class_weight",)),
    "random_forest_custom": _grown("forest", {"n_trees": "trees", "min_samples_split": "min_split"}, ("class_weight",)),
    "random_forest_sklearn": _mllib_forest,
    "svm_rbf": _grown("kernel", {"C": "cost"}, ("gamma", "class_weight")),
    "knn": _grown("nearest", {"n_neighbors": "k"}, ("metric",)),
    "lightgbm": _grown("leaf_wise", _BOOST, ("seed",)),
    "xgboost": _grown("level_wise", _BOOST, ("seed",)),
}
for _name, _stages in build_stages.items():
    register("model", _name, alone=False)(lambda id_col="id", _stages=_stages, **how: _stages(id_col, how))


def pipeline(name: str, features: list[str], target: str, id_col: str = "id", **how) -> Pipeline:
    """From rows with named features and a named class to predictions and their names."""
    first = [FeatureMatrix(inputCols=list(features)), LabelCoder(inputCol=target), Standardiser()]
    return Pipeline(stages=[*first, *classifier(name, id_col, **how), LabelDecoder(inputCol=target)])
