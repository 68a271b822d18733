"""Exact trees and forests against plain ones that read their rows one by one."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from motionlake.learning import prefix, trees

SCHEMA = "id long, label int, features array<double>"


def _entropy(labels):
    n = len(labels)
    return -sum(c / n * math.log(c / n) for c in Counter(labels).values())


def plain(rows, max_depth=100, min_split=2):
    """rows: (label, features) repeated by their copies. {node: (n, label, feature, threshold)}."""
    out = {}

    def grow(own, node):
        labels = [y for y, _ in own]
        counts = Counter(labels)
        label = min(counts, key=lambda y: (-counts[y], y))
        best = None
        if len(counts) > 1 and len(own) >= min_split and len(node) < max_depth:
            for f in range(len(own[0][1])):
                for t in sorted({x[f] for _, x in own})[:-1]:
                    left, right = [y for y, x in own if x[f] <= t], [y for y, x in own if x[f] > t]
                    gain = round(_entropy(labels) - len(left) / len(own) * _entropy(left) - len(right) / len(own) * _entropy(right), 10)
                    if best is None or gain > best[0]:
                        best = gain, f, t
        out[node] = (len(own), label, *(best[1:] if best else (None, None)))
        if best:
            grow([r for r in own if r[1][best[1]] <= best[2]], node + "0")
            grow([r for r in own if r[1][best[1]] > best[2]], node + "1")

    grow(rows, "")
    return out


def walk(nodes, x):
    node = ""
    while nodes[node][2] is not None:
        node += "0" if x[nodes[node][2]] <= nodes[node][3] else "1"
    return node


def made(seed, n=90, values=6):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(3), [float(rng.randrange(values)), rng.gauss(0, 1), float(rng.randrange(2)), 1.0]) for i in range(n)]
    return rows + [(n + i, y, [2.0, 0.5, 1.0, 1.0]) for i, y in enumerate((2, 1, 1, 2))]  # equal rows of two labels


def got(nodes, tree=0):
    return {r["node"]: (r["n"], r["label"], r["feature"], r["threshold"]) for r in nodes.where(F.col("tree") == tree).collect()}


@pytest.mark.parametrize("seed, how", [(1, {}), (2, {"max_depth": 3}), (3, {"min_split": 20})])
def test_tree(spark, seed, how):
    rows = made(seed)
    nodes = trees.grow(spark.createDataFrame(rows, SCHEMA), **how)
    want = plain([r[1:] for r in rows], **how)
    assert got(nodes) == want
    at = {r["id"]: r["node"] for r in trees.leaves(spark.createDataFrame(rows, SCHEMA), nodes).collect()}
    assert at == {i: walk(want, x) for i, _, x in rows}
    split = Counter(v[2] for v in want.values() if v[2] is not None)
    assert {r["feature"]: r["importance"] for r in trees.importances(nodes).collect()} == pytest.approx({f: n / split.total() for f, n in split.items()})


def test_forest(spark):
    """Each tree is the plain tree of its own draw; labels are those of most trees."""
    rows = made(4, 70)
    df = spark.createDataFrame(rows, SCHEMA)
    sample = trees.bootstrap(df, 5, seed=7)
    nodes = trees.grow(df, sample, per_node=4)
    drawn = {}
    for r in sample.collect():
        drawn.setdefault(r["tree"], []).extend([rows[r["id"]][1:]] * r["copies"])
    want = {t: plain(own) for t, own in drawn.items()}
    assert all(got(nodes, t) == want[t] for t in want) and len(want) == 5
    said = {i: Counter(want[t][walk(want[t], x)][1] for t in want) for i, _, x in rows}
    assert {r["id"]: r["label"] for r in trees.predicted(df, nodes).collect()} == {i: min(c, key=lambda y: (-c[y], y)) for i, c in said.items()}


def test_features_drawn_for_a_node(spark):
    """Of two features a node tries one; where it is constant, the other divides it."""
    rows = [(i, i % 2, [1.0, float(i % 2)]) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    nodes = trees.grow(df, trees.bootstrap(df, 8), per_node=1)
    roots = nodes.where("node = ''").collect()
    assert len(roots) == 8 and all(r["feature"] == 1 for r in roots) and nodes.where("depth > 1").count() == 0


def test_balanced_draws(spark):
    df = spark.createDataFrame([(i, int(i < 40), [0.0]) for i in range(4000)], SCHEMA)
    drawn = trees.bootstrap(df, 10).join(df, "id").groupBy("label").agg(F.sum("copies").alias("n"))
    assert {r["label"]: r["n"] / 20000 for r in drawn.collect()} == pytest.approx({0: 1.0, 1: 1.0}, abs=0.05)
    many = spark.range(4000).select(trees.poisson(200.0, F.col("id")).alias("n")).agg(F.avg("n"), F.var_samp("n")).first()
    assert many[0] == pytest.approx(200, rel=0.01) and many[1] == pytest.approx(200, rel=0.1)


def test_no_rows_and_one_label(spark):
    assert trees.grow(spark.createDataFrame([], SCHEMA)).collect() == []
    one = trees.grow(spark.createDataFrame([(1, 2, [0.0]), (2, 2, [1.0])], SCHEMA))
    assert got(one) == {"": (2, 2, None, None)}


def test_running_sums_over_ranges(spark):
    rng = random.Random(0)
    rows = [(g, float(v), rng.randrange(5)) for g in "ab" for v in range(300 if g == "a" else 3)]
    out = prefix.running_sums(spark.createDataFrame(rows, "g string, v double, n long").repartition(4), ["g"], "v", ["n"]).collect()
    for r in out:
        own = [n for g, v, n in rows if g == r["g"]]
        assert r["left_n"] == sum(n for g, v, n in rows if g == r["g"] and v <= r["v"]) and r["all_n"] == sum(own)
    assert len(out) == len(rows)
