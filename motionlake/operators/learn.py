"""Labels, folds, scaling, neighbours, votes and scores."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .reuse import written


def class_distribution(rows: DataFrame, label: str = "label") -> DataFrame:
    return rows.groupBy(label).agg(F.count("*").alias("n"))


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """Per class: balanced n / (k n_c), inverse 1 / n_c scaled to a sum of 1, and max / n_c."""
    counted = class_distribution(rows, label)
    total = counted.agg(F.sum("n").alias("all"), F.count("*").alias("k"), F.max("n").alias("most"), F.sum(1 / F.col("n")).alias("inv"))
    return counted.join(F.broadcast(total)).select(label, "n", (F.col("all") / (F.col("k") * F.col("n"))).alias("balanced"), (1 / F.col("n") / F.col("inv")).alias("inverse"), (F.col("most") / F.col("n")).alias("to_largest"))


def training_viability(rows: DataFrame, label: str = "label", folds: int = 5, per_class: int = 3) -> DataFrame:
    """One row: samples, classes, the smallest class, and the first check that fails, else OK."""
    s = class_distribution(rows, label).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("samples"), F.count("*").alias("classes"), F.min("n").alias("smallest"))
    message = F.when(F.col("samples") < F.col("classes") * per_class, "too few samples").when(F.col("smallest") < per_class, "rare classes").when(F.col("samples") < F.col("classes") * folds, "too few for folds").otherwise("OK")
    return s.withColumn("message", message)


def encode_labels(rows: DataFrame, label: str) -> DataFrame:
    """Adds code: the label's place among the distinct labels in order, from 0; rows without a label are left out.

    Labels are dealt out in ranges; a label's place is that in its range and the number of
    labels in the ranges before. The join is left to Spark, which broadcasts by size.
    """
    named = rows.where(F.col(label).isNotNull()).select(label).distinct().repartitionByRange(label).withColumn("_part", F.spark_partition_id())
    before = named.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))  # one row per range
    place = F.row_number().over(Window.partitionBy("_part").orderBy(label)) - 1
    coded = named.withColumn("_place", place).join(before, "_part").select(label, (F.col("_place") + F.col("_before")).cast("long").alias("code"))
    return rows.join(coded, label)


def stratified_folds(rows: DataFrame, label: str, id_col: str, folds: int = 5, order: Column | None = None) -> DataFrame:
    """Adds fold: rows of a class are dealt out in turn, ordered by a hash of the id (or ``order``)."""
    place = F.row_number().over(Window.partitionBy(label).orderBy(order if order is not None else F.xxhash64(id_col), id_col))
    return rows.withColumn("fold", ((place - 1) % folds).cast("long"))


def holdout(rows: DataFrame, label: str, id_col: str, share: float = 0.2, order: Column | None = None) -> DataFrame:
    """Adds held_out: the first ``share`` of each class in order of a hash of the id (or ``order``), rounded up.

    A class of one row is held in, so every class can be learned.
    """
    by = Window.partitionBy(label)
    place, n = F.row_number().over(by.orderBy(order if order is not None else F.xxhash64(id_col), id_col)), F.count("*").over(by)
    return rows.withColumn("held_out", (place <= F.ceil(n * share)) & (n > 1))


def zscores(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, dim, z: each dimension scaled to mean 0 and population deviation 1; a constant one to 0.

    Means and deviations are aggregated per dimension (a small table) and joined back.
    """
    long = vectors.select(F.col(id_col).alias("id"), F.posexplode(vec_col).alias("dim", "v")).withColumn("v", F.col("v").cast("double"))
    stats = long.groupBy("dim").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    return long.join(F.broadcast(stats), "dim").select("id", "dim", ((F.col("v") - F.col("mean")) / F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))).alias("z"))


#: Blocks of queries whose nearest rows so far a task holds before it hands them on.
HELD = 64


def nearest(queries: DataFrame, base: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 2048) -> DataFrame:
    """id, other, distance, place: the k nearest base rows of each query row, exactly; ties by id.

    Both sides are packed once into blocks of a bounded size, and tasks go through pairs of
    blocks. A single-precision matrix product with a bound on its error rules out what can't
    be among the k; the distances of the rest are summed in double precision, component by
    component. A task hands on k rows a query for all base blocks that it has seen. A row's own
    id is no neighbour; rows without finite distances have none.
    """

    def blocks(df: DataFrame, name: str, copies: int | None) -> DataFrame:
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vectors = np.zeros(0, np.int64), None
            for batch in _ended(batches):
                if batch is not None and batch.num_rows:
                    v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    ids, vectors = np.append(ids, batch.column(0).to_numpy()), v if vectors is None else np.vstack([vectors, v])
                while len(ids) >= block or (batch is None and len(ids)):
                    yield packed(ids[:block], vectors[:block])
                    ids, vectors = ids[block:], vectors[block:]

        def packed(ids: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            fine = np.isfinite((v * v).sum(1))
            order = np.flatnonzero(fine)[np.argsort(ids[fine], kind="stable")]
            if copies and len(order):  # of equal vectors, those of the least ids are before all others everywhere
                same = np.unique(v[order] + 0.0, axis=0, return_inverse=True)[1].reshape(-1)
                by = np.argsort(same, kind="stable")
                first = np.append(True, same[by][1:] != same[by][:-1])
                starts = np.flatnonzero(first)
                kept = np.arange(len(by)) - starts[np.cumsum(first) - 1] < copies
                order = order[np.sort(by[kept])]
            made = [uuid.uuid4().bytes, ids[order].tobytes(), v[order].tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in made], [name, f"{name}_ids", f"{name}_vectors"])

        n = max(1, -(-df.count() // block))
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).repartition(n)
        return written(rows.mapInArrow(pack, f"{name} binary, {name}_ids binary, {name}_vectors binary"), f"{name}_blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, Nearest] = {}
        for batch in _ended(batches):
            for i in range(batch.num_rows if batch is not None else 0):
                name, qi, q, _, bi, b = (c[i].as_buffer() for c in batch.columns)
                name, qi, bi = name.to_pybytes(), np.frombuffer(qi, np.int64), np.frombuffer(bi, np.int64)
                if not len(qi) or not len(bi):
                    continue
                if name not in held:
                    if len(held) == HELD:
                        yield from (x.batch() for x in held.values())
                        held.clear()
                    held[name] = Nearest(qi, np.frombuffer(q).reshape(len(qi), -1).copy(), k)
                held[name].see(bi, np.frombuffer(b).reshape(len(bi), -1))
        yield from (x.batch() for x in held.values())

    pairs = blocks(queries, "q", None).crossJoin(blocks(base, "b", k + 1)).mapInArrow(run, "id long, other long, distance double")
    place = F.row_number().over(Window.partitionBy("id").orderBy("distance", "other"))
    return pairs.withColumn("place", place.cast("long")).where(F.col("place") <= k)


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches, and None at the end."""
    yield from batches
    yield None


class Nearest:
    """The ``k`` nearest of the rows seen so far, of each row of a block of queries."""

    STRIP = 256  #: queries that are compared at once

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k, self.norms = ids, vectors, k, np.sqrt((vectors * vectors).sum(1))
        self.distance, self.other = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)

    def see(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        squares = (vectors * vectors).sum(1)
        widest = float(np.sqrt(squares.max()))
        kind = np.float32 if (self.norms.max() + widest) ** 2 < 1e30 else np.float64
        wide = np.hstack([-2 * vectors, squares[:, None]]).astype(kind).T
        for start in range(0, len(self.ids), self.STRIP):
            rows = slice(start, start + self.STRIP)
            q, norms = self.vectors[rows], self.norms[rows]
            least = np.hstack([q, np.ones((len(q), 1))]).astype(kind) @ wide  # squared distance less the query's square
            slack = (vectors.shape[1] + 16) * float(np.finfo(kind).eps) * (norms + widest) ** 2 + np.finfo(kind).tiny
            bound = self.distance[rows, -1] ** 2 * (1 + 1e-12) - norms**2 + slack
            if not np.isfinite(bound).all() and len(ids) > self.k + 1:  # one may be the query itself
                bound = np.minimum(bound, np.partition(least, self.k, axis=1)[:, self.k] + 2 * slack)
            at = np.flatnonzero(least <= np.nextafter(bound.astype(kind), kind(np.inf))[:, None])
            if not len(at):
                continue
            i, j = np.divmod(at, len(ids))
            other = self.ids[rows][i] != ids[j]
            self._keep(start + i[other], ids[j[other]], vectors[j[other]])

    def _keep(self, i: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        d = np.zeros(len(i))
        for c in range(vectors.shape[1]):
            d += (self.vectors[i, c] - vectors[:, c]) ** 2
        changed = np.unique(i)
        i = np.concatenate([i, np.repeat(changed, self.k)])
        d = np.concatenate([np.sqrt(d), self.distance[changed].reshape(-1)])
        ids = np.concatenate([ids, self.other[changed].reshape(-1)])
        order = np.lexsort((ids, d, i))
        starts = np.searchsorted(i[order], changed)
        best = order[starts[:, None] + np.arange(self.k)]
        self.distance[changed], self.other[changed] = d[best], ids[best]

    def batch(self) -> pa.RecordBatch:
        i, j = np.nonzero(np.isfinite(self.distance))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[i]), pa.array(self.other[i, j]), pa.array(self.distance[i, j])], ["id", "other", "distance"])


def vote(votes: DataFrame, by: str = "id", label: str = "label", weight: Column | None = None) -> DataFrame:
    """id, label with the most (or heaviest) votes; of equals the smallest label."""
    summed = votes.groupBy(by, label).agg(F.sum(weight if weight is not None else F.lit(1)).alias("votes"))
    return summed.groupBy(by).agg(F.min(F.struct((-F.col("votes")).alias("v"), label)).alias("best")).select(by, F.col(f"best.{label}").alias("predicted"))


def model_weights(accuracy: DataFrame, alpha: float, best_first: bool = False) -> DataFrame:
    """model, weight: 1, alpha, alpha squared and so on over models by rising accuracy.

    The least accurate model weighs most, which is the compared system's rule;
    ``best_first`` turns it round.
    """
    order = F.desc("accuracy") if best_first else F.asc("accuracy")
    place = F.row_number().over(Window.orderBy(order, "model")) - 1  # one row per model
    return accuracy.withColumn("weight", F.pow(F.lit(alpha), place)).select("model", "weight")


def confusion(rows: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    return rows.groupBy(truth, predicted).agg(F.count("*").alias("n"))


def scores(rows: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """One row: accuracy and weighted precision, recall and F1 (0 where undefined)."""
    counted = confusion(rows, truth, predicted)
    by_truth = counted.groupBy(F.col(truth).alias("c")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0)).alias("hit"))
    by_pred = counted.groupBy(F.col(predicted).alias("p")).agg(F.sum("n").alias("called"))
    per = by_truth.join(by_pred, F.col("c") == F.col("p"), "left").withColumn("called", F.coalesce("called", F.lit(0)))
    precision = F.when(F.col("called") > 0, F.col("hit") / F.col("called")).otherwise(0.0)
    recall = F.col("hit") / F.col("support")
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    mean = lambda c: F.sum(c * F.col("support")) / F.sum("support")
    return per.agg((F.sum("hit") / F.sum("support")).alias("accuracy"), mean(precision).alias("precision"), mean(recall).alias("recall"), mean(f1).alias("f1"))


def fold_predictions(vectors: DataFrame, label: str = "label", id_col: str = "vec_id", vec_col: str = "embedding", folds: int = 5, dims: tuple[int, int] | None = None, order: Column | None = None, train: bool = False) -> DataFrame:
    """id, truth, predicted, fold, held_out: nearest-mean models, one per fold, over the dimensions ``dims``.

    A fold's model is fitted to the rows of the other folds and predicts its own rows
    (held_out) and, with ``train``, those too. Its class means come from sums by class
    and fold, so rows are read once for all folds; the least squared distance wins, of
    equals the smallest label. Rows with a null label or vector are left out.
    """
    dealt = stratified_folds(vectors.where(F.col(label).isNotNull() & F.col(vec_col).isNotNull()), label, id_col, folds, order)
    long = dealt.select(F.col(id_col).alias("id"), F.col(label).alias("truth"), F.col("fold").alias("own"), F.posexplode(vec_col).alias("dim", "v")).withColumn("v", F.col("v").cast("double"))
    if dims:
        long = long.where((F.col("dim") >= dims[0]) & (F.col("dim") < dims[1]))
    sums = long.groupBy(F.col("truth").alias("predicted"), "dim", "own").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    whole = sums.groupBy("predicted", "dim").agg(F.sum("s").alias("s_all"), F.sum("n").alias("n_all")).withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(folds - 1).cast("long"))))
    means = whole.join(sums.withColumnRenamed("own", "fold"), ["predicted", "dim", "fold"], "left").withColumn("left_n", F.col("n_all") - F.coalesce("n", F.lit(0))).where("left_n > 0")
    means = means.select("predicted", "dim", "fold", ((F.col("s_all") - F.coalesce("s", F.lit(0.0))) / F.col("left_n")).alias("m"))
    rows = long.withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(folds - 1).cast("long")))) if train else long.withColumn("fold", F.col("own"))
    far = rows.join(means, ["fold", "dim"]).groupBy("id", "truth", "own", "fold", "predicted").agg(F.sum((F.col("v") - F.col("m")) * (F.col("v") - F.col("m"))).alias("d"))
    best = far.groupBy("id", "truth", "own", "fold").agg(F.min(F.struct("d", "predicted")).alias("b"))
    return best.select("id", "truth", "b.predicted", "fold", (F.col("own") == F.col("fold")).alias("held_out"))


def cv_summary(predictions: DataFrame) -> DataFrame:
    """Per model, from rows (model, fold, held_out, truth, predicted): mean and population deviation over
    folds of the held-out and of the training accuracy, and the overfit gap between the means."""
    per = predictions.groupBy("model", "fold", "held_out").agg(F.avg((F.col("truth") == F.col("predicted")).cast("double")).alias("accuracy"))
    of = lambda held, f: f(F.when(F.col("held_out") == held, F.col("accuracy")))
    out = per.groupBy("model").agg(of(True, F.avg).alias("accuracy_mean"), of(True, F.stddev_pop).alias("accuracy_std"), of(False, F.avg).alias("train_mean"), of(False, F.stddev_pop).alias("train_std"))
    return out.withColumn("overfit_gap", F.col("train_mean") - F.col("accuracy_mean"))


def fold_summary(per_fold: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: mean and population deviation of each column over folds."""
    return per_fold.agg(*(f(c).alias(f"{c}_{s}") for c in cols for s, f in (("mean", F.avg), ("std", F.stddev_pop))))


def between_class_ratio(vectors: DataFrame, label: str = "label", vec_col: str = "embedding", k: int = 10) -> DataFrame:
    """dim, ratio: the k dimensions whose class means vary most against the whole variance."""
    long = vectors.select(label, F.posexplode(vec_col).alias("dim", "v")).withColumn("v", F.col("v").cast("double"))
    per = long.groupBy("dim", label).agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.sum(F.col("v") * F.col("v")).alias("q"))
    total, mean = F.sum("n"), F.sum(F.col("n") * F.col("m")) / F.sum("n")
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) / total - mean * mean
    whole = F.sum("q") / total - mean * mean
    return per.groupBy("dim").agg((between / whole).alias("ratio")).orderBy(F.desc("ratio"), "dim").limit(k)
