"""Exact decision trees and balanced bootstrap forests, grown level by level as joins.

A split may lie at every distinct value of a feature. All open nodes of all trees are
split at once: class counts by (tree, node, feature, value), running sums along the
values, and the greatest information gain by (tree, node). Rows are known to a tree by
id, node and number of copies, and meet their features by a join; nothing but the
number of classes comes to the driver, so trees may be as deep and as many as the rows.
Nodes of few rows are grown to their leaves in one task, by the same rules, and trees of
few nodes take rows to their leaves in one task; both are bounded.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.reuse import written
from .prefix import running_sums

#: Means up to which a bootstrap's Poisson numbers come from their exact distribution, beyond it from the normal one.
EXACT_MEAN = 50.0
#: Feature values of a node that one task grows to its leaves; nodes of a tree, and rows, that meet in one task.
LOCAL_VALUES, LOCAL_NODES, LOCAL_ROWS = 2_000_000, 200_000, 20_000
NODES = "tree int, node string, depth int, n long, label int, feature int, threshold double, gain double"


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on ``parts`` only."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def poisson(mean: float, *name: Column) -> Column:
    """A Poisson number for each ``name``, repeatable."""
    u = _uniform(F.lit("copies"), *name)
    if mean > EXACT_MEAN:
        z = F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * _uniform(F.lit("turn"), *name))
        return F.greatest(F.lit(0), F.round(mean + math.sqrt(mean) * z)).cast("long")
    term, total, bounds = math.exp(-mean), 0.0, []
    while total < 1 - 1e-12 and len(bounds) < 400:
        total += term
        bounds.append(total)
        term *= mean / len(bounds)
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= u)).cast("long")


def bootstrap(rows: DataFrame, trees: int, balanced: bool = True, seed: int = 42) -> DataFrame:
    """tree, id, copies: each tree's own draw of as many rows as there are, with replacement.

    The number of copies of a row is a Poisson number of mean 1 or, ``balanced``, of n / (k
    n_c), so that the k classes have equal shares; draws depend on seed, tree and id.
    """
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # one row a class
    n, copies = sum(counts.values()), F.lit(0).cast("long")
    for label, own in sorted(counts.items()):
        copies = F.when(F.col("label") == label, poisson(n / (len(counts) * own) if balanced else 1.0, F.lit(seed), F.col("tree"), F.col("id"))).otherwise(copies)
    drawn = rows.select("id", "label", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    return drawn.select("tree", "id", copies.alias("copies")).where("copies > 0")


def entropy(counts: Sequence[Column]) -> Column:
    n = sum(counts[1:], counts[0])
    return -sum((F.when(c > 0, c / n * F.log(c / n)).otherwise(0.0) for c in counts), F.lit(0.0))


def grow(rows: DataFrame, sample: DataFrame | None = None, per_node: int | None = None, max_depth: int = 100, min_split: int = 2, seed: int = 42) -> DataFrame:
    """The nodes of trees over ``rows`` (id, label from 0, features array<double>).

    tree, node (the way from the root: 0 for at most the threshold, 1 for above), depth, n,
    label (most frequent, of equals the smallest), and of inner nodes feature, threshold and
    gain. ``sample`` (tree, id, copies) tells each tree's rows; without it there is one tree
    of all. A node is split at the value of a feature whose information gain is greatest; of
    equals the first feature, then the smallest value; with ``per_node`` only so many
    features are tried, in an order drawn for the node, and the next so many if none of
    them divides it. Nodes of one label, of fewer than ``min_split`` rows or without two
    different rows stay leaves. No rows give no nodes; ids are unique and labels not null.
    """
    gaps = F.exists("features", lambda v: v.isNull())
    first = rows.agg(F.max("label").alias("k"), F.max(F.size("features")).alias("m"), F.min(F.size("features")).alias("least"), F.max(gaps).alias("gaps")).first()
    if first["k"] is None:
        return rows.sparkSession.createDataFrame([], NODES)
    k, m = first["k"] + 1, first["m"]
    take, key = min(per_node or m, m), ["tree", "node"]
    classes = [f"c{i}" for i in range(k)]
    sample = rows.select(F.lit(0).alias("tree"), "id", F.lit(1).cast("long").alias("copies")) if sample is None else sample
    state = written(sample.select("tree", F.lit("").alias("node"), F.lit(0).alias("turn"), "id", "copies"), "roots")
    stats, splits = [], []
    few = LOCAL_VALUES // max(m, 1) if m == first["least"] and not first["gaps"] else 0
    while True:
        if few:
            small = written(state.groupBy(*key).agg(F.count("*").alias("rows")).where(F.col("rows") <= few).select(*key), "small")
            ready = state.join(small, key, "left_semi").join(rows, "id").select(*key, "turn", F.col("label").cast("int").alias("label"), "copies", F.col("features").cast("array<double>").alias("features"))
            found = written(_dealt(ready, key).groupBy(*key).applyInArrow(_subtree(k, m, take, max_depth, min_split, seed), FOUND), "subtrees")
            stats.append(found.select(*key, "n", "label"))
            splits.append(found.where("feature is not null").select(*key, "feature", "threshold", "gain"))
            state = written(state.join(small, key, "left_anti"), "large")
            if state.isEmpty():
                break
        active = state.join(rows, "id")
        count = {c: F.sum(F.when(F.col("label") == i, F.col("copies")).otherwise(0)) for i, c in enumerate(classes)}
        counted = active.groupBy(*key, "turn").agg(*(f.alias(c) for c, f in count.items()))
        n, most = sum(map(F.col, classes[1:]), F.col(classes[0])), F.greatest(*classes) if k > 1 else F.col(classes[0])
        label = F.array_position(F.array(*classes), most).cast("int") - 1
        open_ = (most < n) & (n >= min_split) & (F.length("node") < max_depth)
        order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda f: F.struct(F.xxhash64(F.lit(seed), F.col("tree"), F.col("node"), f).alias("by"), f.alias("f"))))
        tried = F.sequence(F.lit(0), F.lit(m - 1)) if take == m else F.slice(F.transform(order, lambda x: x["f"]), F.col("turn") * take + 1, F.lit(take))
        stat = written(counted.select(*key, "turn", n.alias("n"), label.alias("label"), open_.alias("open"), F.when(open_, tried).alias("tried")), "stats")
        stats.append(stat.select(*key, "n", "label"))
        long = active.join(stat.where("open").select(*key, "tried"), key).select(*key, "label", "copies", "features", F.explode("tried").alias("feature"))
        by_value = long.groupBy(*key, "feature", F.get("features", F.col("feature")).alias("value")).agg(*(f.alias(c) for c, f in count.items()))
        summed = running_sums(by_value, [*key, "feature"], "value", classes)
        left, whole = [F.col(f"left_{c}") for c in classes], [F.col(f"all_{c}") for c in classes]
        right = [w - x for w, x in zip(whole, left, strict=True)]
        n_left, n_all = sum(left[1:], left[0]), sum(whole[1:], whole[0])
        gain = entropy(whole) - n_left / n_all * entropy(left) - (n_all - n_left) / n_all * entropy(right)
        best = F.max(F.struct(F.round(gain, 10).alias("gain"), (-F.col("feature")).alias("f"), (-F.col("value")).alias("v")))
        split = summed.where(n_left < n_all).groupBy(*key).agg(best.alias("b"))
        split = written(split.select(*key, (-F.col("b.f")).alias("feature"), (-F.col("b.v")).alias("threshold"), F.col("b.gain").alias("gain")), "splits")
        splits.append(split)
        again = stat.where(F.col("open") & ((F.col("turn") + 1) * take < m)).select(*key).join(split, key, "left_anti")
        side = F.when(F.get("features", F.col("feature")) <= F.col("threshold"), "0").otherwise("1")
        moved = active.join(split, key).select("tree", F.concat("node", side).alias("node"), F.lit(0).alias("turn"), "id", "copies")
        kept = state.join(again, key, "left_semi").select("tree", "node", (F.col("turn") + 1).alias("turn"), "id", "copies")
        state = written(moved.unionByName(kept) if take < m else moved, "state")
        if state.isEmpty():
            break
    union = lambda parts: parts[0] if len(parts) == 1 else union(parts[: len(parts) // 2]).unionByName(union(parts[len(parts) // 2 :]))
    last = union(stats).groupBy(*key).agg(F.max("n").alias("n"), F.max("label").alias("label"))
    nodes = last.join(union(splits), key, "left")
    return written(nodes.select("tree", "node", F.length("node").alias("depth"), "n", "label", "feature", "threshold", "gain"), "nodes")


FOUND = "tree int, node string, n long, label int, feature int, threshold double, gain double"


def _dealt(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """``rows`` by ``key`` in a number of parts that small tables keep: groups are few and take long."""
    return rows.repartition(4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def xxh64(data: bytes, seed: int) -> int:
    """XXH64, as Spark's xxhash64 takes the bytes of a string or the four of an int after the hash before."""
    p1, p2, p3, p4, p5, mask = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, (1 << 64) - 1
    turn = lambda x, r: (x << r | x >> 64 - r) & mask
    word = lambda at, n: int.from_bytes(data[at : at + n], "little")
    step = lambda acc, x: turn((acc + x * p2) & mask, 31) * p1 & mask
    at = 0
    if len(data) >= 32:
        v = [(seed + p1 + p2) & mask, (seed + p2) & mask, seed, (seed - p1) & mask]
        while at + 32 <= len(data):
            v = [step(a, word(at + 8 * i, 8)) for i, a in enumerate(v)]
            at += 32
        h = sum(turn(a, r) for a, r in zip(v, (1, 7, 12, 18), strict=True)) & mask
        for a in v:
            h = ((h ^ step(0, a)) * p1 + p4) & mask
    else:
        h = (seed + p5) & mask
    h = (h + len(data)) & mask
    while at + 8 <= len(data):
        h = (turn(h ^ step(0, word(at, 8)), 27) * p1 + p4) & mask
        at += 8
    if at + 4 <= len(data):
        h = (turn(h ^ word(at, 4) * p1 & mask, 23) * p2 + p3) & mask
        at += 4
    for c in data[at:]:
        h = turn(h ^ c * p5 & mask, 11) * p1 & mask
    h = (h ^ h >> 33) * p2 & mask
    h = (h ^ h >> 29) * p3 & mask
    return h ^ h >> 32


def drawn_order(seed: int, tree: int, node: str, m: int) -> list[int]:
    """The features in the order that is drawn for a node: that of xxhash64(seed, tree, node, feature) as a signed number."""
    h = 42
    for part in (seed.to_bytes(4, "little", signed=True), tree.to_bytes(4, "little", signed=True), node.encode()):
        h = xxh64(part, h)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return sorted(range(m), key=lambda f: (signed(xxh64(f.to_bytes(4, "little"), h)), f))


def _spread(counts: np.ndarray) -> np.ndarray:
    """Entropy along the last axis, added up in order of the classes as ``entropy`` does."""
    n, out = counts.sum(-1), np.zeros(counts.shape[:-1])
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(counts.shape[-1]):
            share = counts[..., c] / n
            out += np.where(counts[..., c] > 0, share * np.log(share), 0.0)
    return -out


def _best(x: np.ndarray, weighted: np.ndarray, tried: Sequence[int]) -> tuple[float, int, float] | None:
    """gain, feature and threshold of the best split of rows ``x`` with copies by class ``weighted``; None if no feature differs."""
    whole, best = weighted.sum(0), None
    n, all_ = whole.sum(), _spread(whole[None])[0]
    for f in tried:
        order = np.argsort(x[:, f], kind="stable")
        v = x[order, f]
        at = np.flatnonzero((v[:-1] < v[1:]) | (np.isnan(v[1:]) & ~np.isnan(v[:-1])))  # not a number is after all numbers
        if not len(at):
            continue
        left = weighted[order].cumsum(0)[at]
        n_left = left.sum(1)
        gain = np.round(all_ - n_left / n * _spread(left) - (n - n_left) / n * _spread(whole - left), 10)
        i = int(gain.argmax())
        one = float(gain[i]), -int(f), -float(v[at[i]])
        best = one if best is None or one > best else best
    return best and (best[0], -best[1], -best[2] + 0.0)


def _subtree(k: int, m: int, take: int, max_depth: int, min_split: int, seed: int):
    """All rows of a node (tree, node, turn, label, copies, features) to the nodes below it and itself, by the rules of ``grow``."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        tree, root, turn = (rows[c][0].as_py() for c in ("tree", "node", "turn"))
        x = rows["features"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, m)
        weighted = np.zeros((rows.num_rows, k))
        weighted[np.arange(rows.num_rows), rows["label"].to_numpy()] = rows["copies"].to_numpy()
        todo, out = [(root, turn, np.arange(rows.num_rows))], []
        while todo:
            node, turn, own = todo.pop()
            counts, best = weighted[own].sum(0), None
            if counts.max() < counts.sum() >= min_split and len(node) < max_depth:
                order = list(range(m)) if take == m else drawn_order(seed, tree, node, m)
                for start in range(turn * take, m, take):
                    if best := _best(x[own], weighted[own], order[start : start + take]):
                        break
            out.append((tree, node, int(counts.sum()), int(counts.argmax()), *((best[1], best[2], best[0]) if best else (None, None, None))))
            if best:
                low = x[own, best[1]] <= best[2]
                todo += [(node + "0", 0, own[low]), (node + "1", 0, own[~low])]
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in FOUND.split(", ")])

    return run


def _walked(rows: pa.Table, nodes: pa.Table) -> pa.Table:
    """id, tree, node, label, n of the leaves of one tree's ``nodes`` that ``rows`` (tree, part, id, features) come to."""
    names = nodes["node"].to_pylist()
    place = {name: i for i, name in enumerate(names)}
    feature = nodes["feature"].to_numpy(zero_copy_only=False)
    inner = ~np.isnan(feature.astype(float))
    feature, threshold = np.where(inner, feature, 0).astype(int), nodes["threshold"].to_numpy(zero_copy_only=False)
    below = np.array([[place.get(name + side, 0) for side in "01"] for name in names]).reshape(-1, 2)
    at, going = np.full(rows.num_rows, place.get("", 0)), np.arange(rows.num_rows)
    if rows.num_rows and len(names):
        x = rows["features"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
        while len(going := going[inner[at[going]]]):
            here = at[going]
            at[going] = below[here, np.where(x[going, feature[here]] <= threshold[here], 0, 1)]
    else:
        rows = rows.slice(0, 0)
        at = at[:0]
    ends = nodes.take(pa.array(at))
    return pa.table([rows["id"], rows["tree"], ends["node"], ends["label"], ends["n"]], ["id", "tree", "node", "label", "n"])


def _in_parts(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``leaves`` of trees of few nodes: a part of the rows meets one tree in a task."""
    parts = max(1, -(-rows.count() // LOCAL_ROWS))
    cut = F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part")
    known = rows.select("id", F.col("features").cast("array<double>").alias("features"), cut).join(nodes.where("node = ''").select(F.col("tree").alias("tree")))
    copied = nodes.select("tree", "node", "label", "n", "feature", "threshold", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    key = ["tree", "part"]
    id_type = rows.schema["id"].dataType.simpleString()
    return _dealt(known, key).groupBy(*key).cogroup(_dealt(copied, key).groupBy(*key)).applyInArrow(_walked, f"id {id_type}, tree int, node string, label int, n long")


def leaves(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, tree, node, label, n of the leaf that each of ``rows`` (id, features) comes to, in every tree.

    Rows go down trees of at most ``LOCAL_NODES`` nodes in one task; if one has more, one level a
    join, and rows that are at a leaf don't move any more.
    """
    sizes = nodes.groupBy("tree").agg(F.count("*").alias("n"), F.max("depth").alias("deep"))
    most, deep = sizes.agg(F.max("n"), F.max("deep")).first()
    wide = rows.agg(F.min(F.size("features")), F.max(F.size("features"))).first() if deep is not None else (None, None)
    if deep is None:
        return rows.sparkSession.createDataFrame([], "id long, tree int, node string, label int, n long")
    if most <= LOCAL_NODES and wide[0] == wide[1] and wide[0]:
        return written(_in_parts(rows, nodes), "leaves")
    trees = nodes.where("node = ''").select("tree")
    down, found = rows.select("id", "features").join(trees).withColumn("node", F.lit("")), None
    for depth in range(deep + 1):
        at = down.join(nodes.where(F.col("depth") == depth).drop("depth", "gain"), ["tree", "node"])
        at = written(at, f"level{depth}")
        done = at.where("feature is null").select("id", "tree", "node", "label", "n")
        found = done if found is None else found.unionByName(done)
        side = F.when(F.get("features", F.col("feature")) <= F.col("threshold"), "0").otherwise("1")
        down = at.where("feature is not null").select("id", "features", "tree", F.concat("node", side).alias("node"))
    return found


def votes(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, label, share: the share of trees that give a row each label."""
    said = leaves(rows, nodes).groupBy("id", "label").agg(F.count("*").alias("n"))
    trees = nodes.where("node = ''").agg(F.count("*").alias("trees"))
    return said.join(F.broadcast(trees)).select("id", "label", (F.col("n") / F.col("trees")).alias("share"))  # one row


def predicted(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, label: the label of most trees, of equals the smallest."""
    best = F.min(F.struct((-F.col("share")).alias("s"), "label"))
    return votes(rows, nodes).groupBy("id").agg(best.alias("b")).select("id", F.col("b.label").alias("label"))


def importances(nodes: DataFrame) -> DataFrame:
    """feature, importance: each feature's share of all splits."""
    counted = nodes.where("feature is not null").groupBy("feature").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("all"))
    return counted.join(F.broadcast(total)).select("feature", (F.col("n") / F.col("all")).alias("importance"))  # one row
