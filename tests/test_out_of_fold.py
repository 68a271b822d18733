"""Models out of fold are fitted to parts of many rows, and to all rows of the other folds."""

import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import functions as F

from motionlake.operators import models


class Watched:
    """A small tree that tells how many rows and parts it was given."""

    seen = []

    def fit(self, rows):
        Watched.seen.append((rows.count(), rows.rdd.getNumPartitions()))
        return DecisionTreeClassifier(maxDepth=2, weightCol="weight").fit(rows)


@pytest.mark.parametrize("most, parts", [(40_000, {1}), (50, {1, 2})])
def test_parts_grow_with_rows_only(spark, monkeypatch, most, parts):
    monkeypatch.setattr(models, "PART_ROWS", most, raising=False)
    Watched.seen.clear()
    rows = spark.range(100).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("label"), (F.col("id") % 7).cast("double").alias("x"))
    found = models.out_of_fold(rows, ["x"], "label", "vec_id", Watched, order=F.col("vec_id"))
    assert found.count() == 100 and found.select("id").distinct().count() == 100
    assert {n for n, _ in Watched.seen} == {80} and {p for _, p in Watched.seen} <= parts
