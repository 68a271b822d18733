"""Nodes that one task grows against those grown by joins, and rows that one task takes to their leaves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionlake.learning import trees


def _rows(spark, n=120, m=6, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.standard_normal((n, m)), 1)
    x[:, 2] = 1.0  # divides nothing
    return spark.createDataFrame([(i, int(rng.integers(3)), v.tolist()) for i, v in enumerate(x)], "id long, label int, features array<double>")


def _plain(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_drawn_order_is_that_of_spark(spark):
    for node in ("", "0", "0110", "01" * 13, "011" * 15):
        by = spark.range(20).select(F.xxhash64(F.lit(42), F.lit(7), F.lit(node), F.col("id").cast("int")).alias("h"), "id")
        assert trees.drawn_order(42, 7, node, 20) == [r["id"] for r in by.orderBy("h", "id").collect()]


@pytest.mark.parametrize("per_node, local", [(2, 150), (None, 300)])
def test_subtrees_are_those_of_joins(spark, monkeypatch, per_node, local):
    rows = _rows(spark)
    sample = trees.bootstrap(rows, 2) if per_node else None
    monkeypatch.setattr(trees, "LOCAL_VALUES", 0)
    want = trees.grow(rows, sample, per_node, max_depth=6)
    monkeypatch.setattr(trees, "LOCAL_VALUES", local)
    assert _plain(trees.grow(rows, sample, per_node, max_depth=6)) == _plain(want)
    monkeypatch.setattr(trees, "LOCAL_ROWS", 50)
    near = trees.leaves(rows, want)
    monkeypatch.setattr(trees, "LOCAL_NODES", 0)
    assert _plain(near) == _plain(trees.leaves(rows, want).select("id", "tree", "node", "label", "n"))
