"""A kernel machine: radial kernel features on landmarks, one-against-one hinge machines, calibrated probabilities.

Rows are mapped to K(x, landmarks) K(landmarks, landmarks)^(-1/2), which is exact where
the landmarks are all rows, and packed into blocks of a written table. All pairs of
classes are fitted at once by Newton steps whose objective and derivatives tasks sum over
their blocks; only these sums, of a size that landmarks and classes bound, come to the
driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reuse import written

BLOCK = 2048  #: rows of a block
_PACKED = "n int, label binary, held binary, phi binary"


@dataclass
class Machine:
    """Of each pair of classes weights and bias, and the sigmoid 1 / (1 + exp(a f + b)) that turns its value into a probability."""

    classes: int
    landmarks: np.ndarray
    gamma: float
    root: np.ndarray
    weights: np.ndarray  # features + 1 by pairs; the last row is the bias
    sigmoid: np.ndarray  # 2 by pairs

    @property
    def pairs(self) -> list[tuple[int, int]]:
        return list(combinations(range(self.classes), 2))

    def features(self, x: np.ndarray) -> np.ndarray:
        return radial(x, self.landmarks, self.gamma) @ self.root

    def values(self, x: np.ndarray) -> np.ndarray:
        """The decision value of each pair; above 0 for its first class."""
        return self.features(x) @ self.weights[:-1] + self.weights[-1]

    def labels(self, values: np.ndarray) -> np.ndarray:
        """The class that wins most pairs, of equals the first."""
        won = np.zeros((len(values), self.classes))
        for p, (i, j) in enumerate(self.pairs):
            won[:, i] += values[:, p] > 0
            won[:, j] += values[:, p] <= 0
        return won.argmax(1)

    def probabilities(self, values: np.ndarray, turns: int = 100) -> np.ndarray:
        """Class probabilities whose pairwise shares are nearest to the pairs' sigmoids (Wu, Lin and Weng, 2004)."""
        n, k = len(values), self.classes
        if k < 2:
            return np.ones((n, k))
        r = np.zeros((n, k, k))
        said = np.clip(1 / (1 + np.exp(np.clip(self.sigmoid[0] * values + self.sigmoid[1], -500, 500))), 1e-7, 1 - 1e-7)
        for p, (i, j) in enumerate(self.pairs):
            r[:, i, j], r[:, j, i] = said[:, p], 1 - said[:, p]
        q = -r * r.transpose(0, 2, 1)
        q[:, range(k), range(k)] = (r**2).sum(1)
        out = np.full((n, k), 1 / k)
        for _ in range(turns):
            for t in range(k):
                qp = np.einsum("nij,nj->ni", q, out)
                diff = ((out * qp).sum(1) - qp[:, t]) / q[:, t, t]
                out[:, t] += diff
                out /= (1 + diff)[:, None]
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """The model as rows (part, place, values)."""
        rows = [("sizes", 0, [float(self.classes), self.gamma])]
        for name in ("landmarks", "root", "weights", "sigmoid"):
            rows += [(name, i, [float(v) for v in row]) for i, row in enumerate(getattr(self, name))]
        return spark.createDataFrame(rows, "part string, place int, values array<double>")

    @classmethod
    def read(cls, table: DataFrame) -> Machine:
        rows = sorted(table.collect(), key=lambda r: (r["part"], r["place"]))  # landmarks and pairs
        of = lambda name: np.array([r["values"] for r in rows if r["part"] == name])
        sizes = of("sizes")[0]
        return cls(int(sizes[0]), of("landmarks"), float(sizes[1]), of("root"), of("weights"), of("sigmoid"))


def radial(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    d = (x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None, :]
    return np.exp(-gamma * np.maximum(d, 0.0))


def spread(rows: DataFrame) -> float:
    """1 / (features * variance of all components), the usual scale of the kernel."""
    x = F.explode("features")
    s = rows.select(x.alias("x")).agg(F.var_pop("x").alias("v")).first()["v"]
    m = rows.agg(F.max(F.size("features")).alias("m")).first()["m"]
    return 1.0 / (m * s) if m and s else 1.0


def _packed(rows: DataFrame, model: Machine, seed: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((model.landmarks, model.gamma, model.root))  # landmarks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        landmarks, gamma, root = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                label, held = part.column(0).to_numpy(zero_copy_only=False), part.column(2).to_numpy(zero_copy_only=False)
                cols = [[len(x)], [label.astype("<i4").tobytes()], [held.astype("u1").tobytes()], [(radial(x, landmarks, gamma) @ root).astype("<f8").tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32(), *[pa.binary()] * 3], strict=True)], ["n", "label", "held", "phi"])

    fold = F.pmod(F.xxhash64(F.lit(seed), F.lit("held"), "id"), F.lit(5)) == 0
    return rows.select("label", F.col("features").cast("array<double>").alias("features"), fold.cast("int").alias("held")).mapInArrow(run, _PACKED)


def _block(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = row["n"]
    phi = np.frombuffer(row["phi"], "<f8").reshape(n, -1)
    return np.frombuffer(row["label"], "<i4"), np.frombuffer(row["held"], "u1").astype(bool), np.hstack([phi, np.ones((n, 1))])


def _summed(rows, zero, add):
    """``add(total, row)`` over all rows, by trees of tasks."""
    return rows.treeAggregate(zero, add, lambda a, b: tuple(x + y for x, y in zip(a, b, strict=True)))


def _hinges(label: np.ndarray, z: np.ndarray, p: int, pair: tuple[int, int], costs: np.ndarray, soft: float):
    """Of each row, for a pair's values ``z``: softened hinge times cost, its slope in the value, and its curvature."""
    y = np.where(label == pair[0], 1.0, np.where(label == pair[1], -1.0, 0.0))
    gap, own = 1 - y * z, np.where(y > 0, costs[pair[0]], np.where(y < 0, costs[pair[1]], 0.0))
    near = (gap > 0) & (gap < soft)
    return own * np.where(gap >= soft, gap - soft / 2, np.where(near, gap * gap / (2 * soft), 0.0)), -y * own * np.clip(gap / soft, 0.0, 1.0), own * near / soft


def _newton(rows, context, w: np.ndarray, pairs, costs: np.ndarray, soft: float, held_in: bool, turns: int, tolerance: float) -> np.ndarray:
    """Per pair, half the squared weights plus the rows' costs times their softened hinges, minimised.

    The objective is quadratic between the rows' kinks: one pass sums gradients and second
    derivatives, of which only rows within a kink have any; a second one the objective at
    all lengths of step at once.
    """
    free = np.vstack([np.ones((len(w) - 1, 1)), np.zeros((1, 1))])  # the bias is not held down
    lengths = np.append(0.0, 0.5 ** np.arange(16))

    def part(row):
        label, held, x = _block(row)
        return (label[~held], x[~held]) if held_in else (label, x)

    for _ in range(turns):
        at = context.broadcast(w)

        def add(total, row, at=at):
            label, x = part(row)
            z, (slope, bend) = x @ at.value, total
            for p, pair in enumerate(pairs):
                _, s, c = _hinges(label, z[:, p], p, pair, costs, soft)
                slope[:, p] += x.T @ s
                near = np.flatnonzero(c)
                bend[p] += (x[near] * c[near, None]).T @ x[near]
            return slope, bend

        slope, bend = _summed(rows, (np.zeros_like(w), np.zeros((len(pairs), len(w), len(w)))), add)
        grad = slope + free * w
        way = -np.stack([np.linalg.solve(bend[p] + np.diag(free[:, 0] + 1e-9), grad[:, p]) for p in range(len(pairs))], 1)
        to = context.broadcast((w, way))

        def along(total, row, to=to):
            label, x = part(row)
            z, dz = x @ to.value[0], x @ to.value[1]
            out = np.zeros_like(total[0])
            for p, pair in enumerate(pairs):
                for i, t in enumerate(lengths):
                    out[i, p] = _hinges(label, z[:, p] + t * dz[:, p], p, pair, costs, soft)[0].sum()
            return (total[0] + out,)

        (loss,) = _summed(rows, (np.zeros((len(lengths), len(pairs))),), along)
        value = loss + np.stack([0.5 * (free * (w + t * way) ** 2).sum(0) for t in lengths])
        best = value.argmin(0)
        at.unpersist()
        to.unpersist()
        w = w + lengths[best] * way
        if (value[0] - value.min(0) <= tolerance * np.maximum(np.abs(value[0]), 1.0)).all():
            break
    return w


def _sigmoids(rows, model: Machine) -> np.ndarray:
    """Per pair the sigmoid that fits the held-out rows' labels best: Newton steps on the log loss (Platt, 2000)."""
    pairs, w = model.pairs, model.weights

    def counted(total, row):
        label, held, _ = _block(row)
        own = label[held]
        return (total[0] + np.array([[(own == i).sum(), (own == j).sum()] for i, j in pairs]),)

    (n,) = _summed(rows, (np.zeros((len(pairs), 2)),), counted)
    high, low = (n[:, 0] + 1) / (n[:, 0] + 2), 1 / (n[:, 1] + 2)
    ab = np.stack([np.zeros(len(pairs)), np.log((n[:, 1] + 1) / (n[:, 0] + 1))])
    lengths = np.append(0.0, 0.5 ** np.arange(12))
    for _ in range(50):

        def add(total, row, ab=ab):
            label, held, x = _block(row)
            label, f = label[held], x[held] @ w
            out = np.zeros((len(pairs), 5))
            for p, (i, j) in enumerate(pairs):
                own = (label == i) | (label == j)
                v, t = f[own, p], np.where(label[own] == i, high[p], low[p])
                s = 1 / (1 + np.exp(np.clip(ab[0, p] * v + ab[1, p], -500, 500)))
                d, h = t - s, s * (1 - s)
                out[p] = (d * v).sum(), d.sum(), (h * v * v).sum(), (h * v).sum(), h.sum()
            return (total[0] + out,)

        (sums,) = _summed(rows, (np.zeros((len(pairs), 5)),), add)
        ga, gb, haa, hab, hbb = sums.T
        haa, hbb = haa + 1e-12, hbb + 1e-12
        det = np.maximum(haa * hbb - hab * hab, 1e-300)
        way = -np.stack([(hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det])

        def along(total, row, ab=ab, way=way):
            label, held, x = _block(row)
            label, f = label[held], x[held] @ w
            out = np.zeros_like(total[0])
            for p, (i, j) in enumerate(pairs):
                own = (label == i) | (label == j)
                v, t = f[own, p], np.where(label[own] == i, high[p], low[p])
                for n_, length in enumerate(lengths):
                    a, b = ab[:, p] + length * way[:, p]
                    out[n_, p] = (np.logaddexp(0, a * v + b) - (1 - t) * (a * v + b)).sum()
            return (total[0] + out,)

        (loss,) = _summed(rows, (np.zeros((len(lengths), len(pairs))),), along)
        ab = ab + lengths[loss.argmin(0)] * way
        if (loss[0] - loss.min(0) <= 1e-8 * np.maximum(loss[0], 1.0)).all():
            break
    return ab


def fit(rows: DataFrame, cost: float = 10.0, gamma: float | None = None, landmarks: int = 128, seed: int = 42, balanced: bool = True, turns: int = 60, tolerance: float = 1e-5) -> Machine:
    """A machine of ``rows`` (id, label from 0, features array<double> of one length, without nulls).

    Landmarks are the rows whose hashes of seed and id are smallest; with no more rows than
    ``landmarks`` the kernel is exact. A row costs ``cost`` times n / (k n_c) of its class if
    ``balanced``. The hinge is rounded off over ever shorter stretches, at last 0.003. The
    sigmoids are those of a machine fitted without a fifth of the rows, on that fifth. A
    class without rows is never predicted; no rows give a machine without classes.
    """
    spark, context = rows.sparkSession, rows.sparkSession.sparkContext
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # one row a class
    classes, n = 1 + max(counts, default=-1), sum(counts.values())
    chosen = rows.select("features", F.xxhash64(F.lit(seed), "id").alias("h"), "id").orderBy("h", "id").limit(landmarks).collect()
    marks = np.unique(np.array([r["features"] for r in chosen], float), axis=0) if chosen else np.zeros((0, 0))
    gamma = spread(rows) if gamma is None else gamma
    vals, vecs = np.linalg.eigh(radial(marks, marks, gamma)) if len(marks) else (np.zeros(0), np.zeros((0, 0)))
    keep = vals > 1e-10 * vals.max(initial=0.0)
    model = Machine(classes, marks, gamma, vecs[:, keep] / np.sqrt(vals[keep]), np.zeros((int(keep.sum()) + 1, 0)), np.zeros((2, 0)))
    if classes < 2:
        return model
    pairs = model.pairs
    costs = np.array([cost * (n / (len(counts) * counts[k]) if balanced else 1.0) if k in counts else 0.0 for k in range(classes)])
    blocks = written(_packed(rows, model, seed).coalesce(1 + n // (4 * BLOCK)), "kernel").rdd  # few rows aren't worth many tasks a step

    def fitted(held_in: bool) -> np.ndarray:
        w = np.zeros((int(keep.sum()) + 1, len(pairs)))
        for soft, loose in ((2.0, 100), (0.3, 100), (0.05, 100), (0.01, 100), (0.003, 1)):  # at first every row is within its kink
            w = _newton(blocks, context, w, pairs, costs, soft, held_in, turns, loose * tolerance)
        return w

    model.weights = fitted(True)
    model.sigmoid = _sigmoids(blocks, model)
    model.weights = fitted(False)
    return model


def predicted(rows: DataFrame, model: Machine, id_col: str = "id") -> DataFrame:
    """id, label and probability (array, one a class) of ``rows`` (id, features)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # landmarks and pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            if own.classes:
                values = own.values(x)
                label, chance = own.labels(values), own.probabilities(values).tolist()
            else:
                label, chance = np.full(len(x), -1), [[] for _ in x]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(label, pa.int32()), pa.array(chance, pa.list_(pa.float64()))], ["id", "label", "probability"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("id"), F.col("features").cast("array<double>").alias("features")).mapInArrow(run, f"id {kind}, label int, probability array<double>")
