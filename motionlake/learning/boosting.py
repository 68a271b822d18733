"""Multiclass gradient boosting on histograms, leaf by leaf or level by level.

Features are cut at quantiles into at most 255 bins and packed, with labels, weights and
scores, into blocks of rows that stay in a written table. For each level of a round's
trees, one for each class, tasks sum gradients by (class, node, feature, bin) of their
blocks; these histograms are added up by key, and the best split of each key is found
where its sums are. Only splits come to the driver. Scores are brought up to date and
written again every few rounds, which also cuts the lineage.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reuse import written

BLOCK, CHUNK, EVERY = 4096, 16, 10  #: rows of a block, features of a key, rounds between writes of the scores
_PACKED = "n int, label binary, weight binary, bins binary, score binary"
TREES = "round int, class int, node int, feature int, threshold double, value double, gain double, n long"


@dataclass(frozen=True)
class Settings:
    """rounds, depth, most leaves of a tree (None: as many as the depth allows), learning rate, bins, penalty on
    leaf values, least rows and least sum of second derivatives of a leaf, how rows weigh (``balanced``: n / (k n_c),
    ``largest``: greatest n_c / n_c, or None), factor of the second derivatives, and whether scores start at the
    classes' shares."""

    rounds: int = 200
    depth: int = 6
    leaves: int | None = 31
    rate: float = 0.1
    bins: int = 255
    l2: float = 0.0
    min_rows: int = 20
    min_hessian: float = 1e-3
    weight: str | None = "balanced"
    factor: float | None = None
    from_shares: bool = True


def leaf_wise(**how) -> Settings:
    """Trees grow where the gain is greatest, to 31 leaves."""
    return Settings(**how)


def level_wise(**how) -> Settings:
    """Trees grow level by level, with a penalty of 1 on leaf values."""
    return Settings(**({"leaves": None, "l2": 1.0, "min_rows": 1, "min_hessian": 1.0, "weight": "largest", "factor": 2.0, "from_shares": False, "bins": 255} | how))


@dataclass
class Tree:
    """One class's tree in heap order: node 1 is the root, 2 i and 2 i + 1 are below i; feature -1 at leaves."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    n: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        size = 2 << depth
        return cls(np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size), np.zeros(size), np.zeros(size, np.int64))

    def route(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node of each row after at most ``depth`` splits."""
        at, rows = np.ones(len(bins), np.int64), np.arange(len(bins))
        for _ in range(depth):
            f = self.feature[at]
            at = np.where(f < 0, at, 2 * at + (bins[rows, np.maximum(f, 0)] > self.bin[at]))
        return at


@dataclass
class Booster:
    """Scores start at ``start``; ``edges`` cut each feature; ``rounds`` has a tree for each class."""

    start: np.ndarray
    edges: list[np.ndarray]
    depth: int
    rounds: list[list[Tree]] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        """How many edges of its feature each value is above."""
        out = np.empty(x.shape, np.uint8)
        for f, edges in enumerate(self.edges):
            out[:, f] = np.searchsorted(edges, x[:, f], "left")
        return out

    def scores(self, bins: np.ndarray, score: np.ndarray | None = None) -> np.ndarray:
        score = np.tile(self.start, (len(bins), 1)) if score is None else score.copy()
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                score[:, k] += tree.value[tree.route(bins, self.depth)]
        return score

    def table(self, spark: SparkSession) -> DataFrame:
        """The model as rows: start values (round -1), edges (round -2) and the trees' nodes."""
        rows = [(-1, k, 0, None, None, float(v), None, None) for k, v in enumerate(self.start)]
        rows += [(-2, f, i, self.depth, float(e), None, None, None) for f, edges in enumerate(self.edges) for i, e in enumerate(edges)]
        rows += [(-2, f, -1, self.depth, None, None, None, None) for f in range(len(self.edges))]
        for r, trees in enumerate(self.rounds):
            for k, t in enumerate(trees):
                for node in np.flatnonzero((t.feature >= 0) | (t.value != 0)):
                    f = int(t.feature[node])
                    rows.append((r, k, int(node), f, float(self.edges[f][t.bin[node]]) if f >= 0 else None, float(t.value[node]), float(t.gain[node]), int(t.n[node])))
        return spark.createDataFrame(rows, TREES)

    @classmethod
    def read(cls, table: DataFrame) -> Booster:
        rows = sorted(table.collect(), key=lambda r: (r["round"], r["class"], r["node"]))  # bounded by rounds, classes and leaves
        start = np.array([r["value"] for r in rows if r["round"] == -1])
        marks = [r for r in rows if r["round"] == -2]
        edges = [np.array([r["threshold"] for r in marks if r["class"] == f and r["node"] >= 0]) for f in range(1 + max((r["class"] for r in marks), default=-1))]
        depth = marks[0]["feature"] if marks else 0
        out = cls(start, edges, depth)
        for r in rows:
            if r["round"] < 0:
                continue
            while len(out.rounds) <= r["round"]:
                out.rounds.append([Tree.empty(depth) for _ in start])
            t, node = out.rounds[r["round"]][r["class"]], r["node"]
            t.value[node], t.gain[node], t.n[node] = r["value"], r["gain"], r["n"]
            if r["feature"] >= 0:
                t.feature[node], t.bin[node] = r["feature"], int(np.searchsorted(edges[r["feature"]], r["threshold"]))
        return out

    def importances(self) -> np.ndarray:
        """How often each feature divides a node."""
        out = np.zeros(len(self.edges))
        for trees in self.rounds:
            for t in trees:
                np.add.at(out, t.feature[t.feature >= 0], 1)
        return out


def softmax(score: np.ndarray) -> np.ndarray:
    e = np.exp(score - score.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def quantile_edges(rows: DataFrame, bins: int) -> list[np.ndarray]:
    """Per feature the values, from the quantiles, between which bins end; the largest value ends none."""
    long = rows.select(F.posexplode("features").alias("f", "v"))
    share = F.array(*(F.lit(i / bins) for i in range(bins)))
    found = long.groupBy("f").agg(F.percentile_approx("v", share, 10_000).alias("q"), F.max("v").alias("top")).collect()  # features x bins
    out = [np.zeros(0) for _ in range(1 + max((r["f"] for r in found), default=-1))]
    for r in found:
        values = np.unique([v for v in r["q"] if v is not None and np.isfinite(v)])
        out[r["f"]] = values[values < r["top"]] if r["top"] is not None else values[:0]
    return out


def _packed(rows: DataFrame, model: Booster, weights: dict[int, float]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                label = part.column(0).to_numpy(zero_copy_only=False).astype("<i4")
                bins = model.binned(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(label), -1))
                weight = np.array([weights[y] for y in label.tolist()], "<f8")
                cols = [[len(label)], [label.tobytes()], [weight.tobytes()], [bins.tobytes()], [model.scores(bins).tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32(), *[pa.binary()] * 4], strict=True)], ["n", "label", "weight", "bins", "score"])

    return rows.select("label", F.col("features").cast("array<double>").alias("features")).mapInArrow(run, _PACKED)


def _rescored(blocks: DataFrame, recent: Booster) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for n, bins, score in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                x = np.frombuffer(bins, np.uint8).reshape(n, -1)
                scores.append(recent.scores(x, np.frombuffer(score, "<f8").reshape(n, -1)).tobytes())
            yield batch.set_column(4, "score", pa.array(scores, pa.binary()))

    return blocks.mapInArrow(run, _PACKED)


def _histograms(rows, shared, open_nodes: list[list[int]], level: int, width: int, factor: float):
    """((class, node, first feature), [3, features, bins]): gradients, second derivatives and rows of a block."""
    recent, grown = shared.value
    for r in rows:
        n = r["n"]
        bins = np.frombuffer(r["bins"], np.uint8).reshape(n, -1)
        label, weight = np.frombuffer(r["label"], "<i4"), np.frombuffer(r["weight"], "<f8")
        p = softmax(recent.scores(bins, np.frombuffer(r["score"], "<f8").reshape(n, -1)))
        for k, nodes in enumerate(open_nodes):
            if not nodes:
                continue
            g = (p[:, k] - (label == k)) * weight
            h = np.maximum(factor * p[:, k] * (1 - p[:, k]), 1e-16) * weight
            at = grown[k].route(bins, level)
            place = np.full(2 << level, -1)
            place[nodes] = np.arange(len(nodes))
            own = place[np.minimum(at, len(place) - 1)]
            own[at >= len(place)] = -1
            here = np.flatnonzero(own >= 0)
            for first in range(0, bins.shape[1], CHUNK):
                part = bins[here, first : first + CHUNK].astype(np.int64)
                many = part.shape[1]
                cell = (own[here, None] * many + np.arange(many)) * width + part
                size = len(nodes) * many * width
                out = np.stack([np.bincount(cell.ravel(), np.repeat(v[here], many), size) if v is not None else np.bincount(cell.ravel(), minlength=size).astype(float) for v in (g, h, None)])
                out = out.reshape(3, len(nodes), many, width)
                for i, node in enumerate(nodes):
                    if out[2, i, 0].any():
                        yield (k, node, first), out[:, i].copy()


def _best(key: tuple[int, int, int], hist: np.ndarray, how: Settings):
    """Of one key the best split: (class, node), (gain, feature, bin, left g, h, n) and the node's g, h, n."""
    up = hist.cumsum(2)
    g, h, n = up[:, 0, -1]
    left, right = up[:, :, :-1], up[:, :, -1:] - up[:, :, :-1]
    worth = lambda a, b: a * a / np.maximum(b + how.l2, 1e-300)
    gain = worth(left[0], left[1]) + worth(right[0], right[1]) - worth(g, h)
    fits = (left[2] >= how.min_rows) & (right[2] >= how.min_rows) & (left[1] >= how.min_hessian) & (right[1] >= how.min_hessian) & (left[2] > 0) & (right[2] > 0)
    gain = np.where(fits, np.round(gain, 9), -np.inf)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape) if gain.size else (0, 0)
    top = float(gain[f, b]) if gain.size else -np.inf
    return key[:2], (top, key[2] + int(f), int(b), *(float(v) for v in left[:, f, b])) if np.isfinite(top) else None, (float(g), float(h), float(n))


def _grown(blocks: DataFrame, recent: Booster, classes: int, how: Settings, factor: float) -> list[Tree]:
    """One tree for each class: all levels are split, then leaves are taken back beyond the most allowed."""
    context, depth = blocks.sparkSession.sparkContext, how.depth
    trees = [Tree.empty(depth) for _ in range(classes)]
    sums: list[dict[int, tuple[float, float, float]]] = [{} for _ in range(classes)]
    open_nodes, width = [[1] for _ in range(classes)], max((len(e) for e in recent.edges), default=0) + 1
    rows = blocks.rdd
    for level in range(depth):
        if not any(open_nodes):
            break
        shared, nodes = context.broadcast((recent, trees)), open_nodes
        hist = rows.mapPartitions(lambda it, shared=shared, nodes=nodes, level=level: _histograms(it, shared, nodes, level, width, factor))
        keys = sum(map(len, nodes)) * -(-len(recent.edges) // CHUNK)
        added = hist.reduceByKey(np.add, max(1, min(keys, context.defaultParallelism)))
        found: dict[tuple[int, int], tuple | None] = {}
        for (k, node), split, total in added.map(lambda kv: _best(*kv, how)).collect():  # one row a key
            sums[k].setdefault(node, total)
            old = found.get((k, node))
            if split and (old is None or (-split[0], split[1]) < (-old[0], old[1])):
                found[k, node] = split
        shared.unpersist()
        open_nodes = [[] for _ in range(classes)]
        for (k, node), (gain, f, b, *left) in sorted(found.items()):
            if gain <= 0:
                continue
            t, total = trees[k], sums[k][node]
            t.feature[node], t.bin[node], t.gain[node], t.n[node] = f, b, gain, round(total[2])
            sums[k][2 * node], sums[k][2 * node + 1] = tuple(left), tuple(a - x for a, x in zip(total, left, strict=True))
            open_nodes[k] += [c for c in (2 * node, 2 * node + 1) if sums[k][c][2] >= 2 * max(how.min_rows, 1)]
    for k, t in enumerate(trees):
        _pruned(t, how.leaves)
        for node, (g, h, n) in sums[k].items():
            if t.feature[node] < 0 and (node == 1 or t.feature[node // 2] >= 0):
                t.value[node], t.n[node] = -how.rate * g / max(h + how.l2, 1e-300), round(n)
    return trees


def _pruned(tree: Tree, most: int | None) -> None:
    """Keep the splits that best-first growth to ``most`` leaves makes: the greatest gain first, of equals the first node."""
    heap, kept = [(-tree.gain[1], 1)] if tree.feature[1] >= 0 else [], set()
    while heap and (most is None or len(kept) + 1 < most):
        _, node = heapq.heappop(heap)
        kept.add(node)
        for c in (2 * node, 2 * node + 1):
            if c < len(tree.feature) and tree.feature[c] >= 0:
                heapq.heappush(heap, (-tree.gain[c], c))
    for node in np.flatnonzero(tree.feature >= 0).tolist():
        if node not in kept:
            tree.feature[node], tree.gain[node] = -1, 0.0


def fit(rows: DataFrame, how: Settings | None = None) -> Booster:
    """A model of ``rows`` (label from 0, features array<double> of one length, without nulls).

    Trees, edges and start scores are bounded by the settings and the number of features;
    the driver holds nothing else. A class that no row has gets the least start score. No
    rows give a model without classes.
    """
    how = how or leaf_wise()
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # one row a class
    classes, n = 1 + max(counts, default=-1), sum(counts.values())
    if not classes:
        return Booster(np.zeros(0), [], how.depth)
    rule = {"balanced": lambda c: n / (len(counts) * c), "largest": lambda c: max(counts.values()) / c, None: lambda c: 1.0}[how.weight]
    weights = {y: rule(c) for y, c in counts.items()}
    mass = np.array([counts.get(k, 0) * weights.get(k, 0.0) for k in range(classes)])
    start = np.log(np.maximum(mass / mass.sum(), 1e-15)) if how.from_shares else np.zeros(classes)
    factor = how.factor or (classes / (classes - 1) if classes > 1 else 1.0)
    model = Booster(start, quantile_edges(rows, how.bins), how.depth)
    blocks = written(_packed(rows, model, weights).coalesce(1 + n // (4 * BLOCK)), "blocks")  # few rows aren't worth many tasks a step
    recent = Booster(start, model.edges, how.depth)
    for turn in range(how.rounds if classes > 1 else 0):
        trees = _grown(blocks, recent, classes, how, factor)
        model.rounds.append(trees)
        recent.rounds.append(trees)
        if (turn + 1) % EVERY == 0 and turn + 1 < how.rounds:
            blocks, recent = written(_rescored(blocks, recent), "blocks"), Booster(start, model.edges, how.depth)
    return model


def probabilities(rows: DataFrame, model: Booster, id_col: str = "id") -> DataFrame:
    """id and probability (array, one a class) of ``rows`` (id, features); none without classes."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # bounded by rounds, classes and leaves

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            p = softmax(own.scores(own.binned(x))) if len(own.start) else np.zeros((len(x), 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.tolist(), pa.list_(pa.float64()))], ["id", "probability"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("id"), F.col("features").cast("array<double>").alias("features")).mapInArrow(run, f"id {kind}, probability array<double>")
