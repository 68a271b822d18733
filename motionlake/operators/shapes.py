"""Track features over the whole trajectory: its hull from blocks, its wavelet energies piece by piece."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import DB4, DB4_HIGH, hull, ring
from .tracks import TRACK, curvature_features

HULL = ["convex_hull_area", "compactness"]
SHAPE = ["mean_curvature", "std_curvature", "turning_rate_rad_s", "convex_hull_area", "compactness", "path_efficiency"]
WAVELET = ["dwt_energy_approx", "dwt_energy_detail1", "dwt_energy_detail2", "dwt_energy_detail3", "dwt_energy_total", "dwt_entropy"]
BLOCK = 4096


def _lists(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The points of each row's last column."""
    p = batch.column(batch.num_columns - 1)
    flat, ends = p.flatten(), np.cumsum(p.value_lengths().to_numpy())
    xy = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")], axis=1).astype(float)
    return np.split(xy, ends[:-1])


def hull_features(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """Hull area and compactness (0 for points on a line) of tracks of four points or more.

    Only the corners of each ``block`` points' hull are merged by track.
    """

    def corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rings = [ring(xy) for xy in _lists(batch)]
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rings])]).astype(np.int32)
            flat = np.concatenate([r.reshape(-1, 2) for r in rings]) if rings else np.zeros((0, 2))
            p = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], ["x", "y"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), p], [*TRACK, "n", "p"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [hull(xy) for xy in _lists(batch)]
            area, around = (np.array([g[i] for g in got], float) for i in (0, 1))
            compact = np.divide(4 * np.pi * area, around**2, out=np.zeros(len(got)), where=around > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(area), pa.array(compact)], [*TRACK, *HULL])

    blocks = points.withColumn("_block", F.floor(F.col("seq") / block)).groupBy(*TRACK, "_block").agg(F.count("*").alias("n"), F.collect_list(F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))).alias("p"))
    rings = blocks.select(*TRACK, "n", "p").mapInArrow(corners, "video_id long, track_id long, n long, p array<struct<x:double,y:double>>")
    merged = rings.groupBy(*TRACK).agg(F.sum("n").alias("n"), F.flatten(F.collect_list("p")).alias("p")).where("n >= 4").select(*TRACK, "p")
    return merged.mapInArrow(whole, ", ".join(["video_id long, track_id long", *(f"{n} double" for n in HULL)]))


def shape_features(points: DataFrame, fps: float = 10.0) -> DataFrame:
    """The six shape features of tracks of four points or more: curvature, turning, hull and path efficiency."""
    return curvature_features(points, fps).join(hull_features(points), TRACK).select(*TRACK, *SHAPE)


def _padded(speeds: DataFrame) -> DataFrame:
    """Rows (track, i, a, n): speeds reflected to a power of two n of 8 or more."""
    bits = F.greatest(F.lit(3), F.length(F.bin(F.col("len") - 1)))
    period = 2 * (F.col("len") - 1)
    turns = F.transform(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / F.greatest(period, F.lit(1)))), lambda k: F.array(k * period + F.col("i"), k * period - F.col("i")))
    places = F.when(F.col("len") == 1, F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).otherwise(F.array_distinct(F.filter(F.flatten(turns), lambda p: (p == F.col("i")) | ((p >= F.col("len")) & (p < F.col("n"))))))
    sized = speeds.withColumn("n", F.pow(F.lit(2.0), bits).cast("long"))
    return sized.select(*TRACK, F.explode(places).alias("i"), "a", "n")


class _Level:
    """One level of a track's decomposition, fed piece by piece: half as many coefficients, and the details' energy.

    The signal is mirrored at both ends; the last seven samples are kept for the next piece.
    """

    def __init__(self) -> None:
        self.kept, self.energy = np.zeros(0), 0.0
        self.begun = False

    def push(self, x: np.ndarray, last: bool) -> np.ndarray:
        """The coefficients that ``x`` completes; ``last`` tells that the signal ends with it."""
        self.kept = np.concatenate([self.kept, x])
        if not self.begun:
            if len(self.kept) < 7:  # no signal ends before
                return np.zeros(0)
            self.kept, self.begun = np.concatenate([self.kept[5::-1], self.kept]), True
        wide = np.concatenate([self.kept, self.kept[: -8 if len(self.kept) > 7 else None : -1]]) if last else self.kept
        count = max((len(wide) - 6) // 2, 0)
        if not count:
            return np.zeros(0)
        taps = np.lib.stride_tricks.sliding_window_view(wide, 8)[0 : 2 * count : 2]
        self.energy += float(((taps @ DB4_HIGH[::-1]) ** 2).sum())
        self.kept = wide[2 * count :]
        return taps @ DB4[::-1]


class _Energies:
    """A track's wavelet energies, from its samples piece by piece in order."""

    def __init__(self, levels: int = 3) -> None:
        self.levels, self.approx = [_Level() for _ in range(levels)], 0.0

    def push(self, x: np.ndarray, last: bool) -> None:
        for level in self.levels:
            x = level.push(x, last)
        self.approx += float((x**2).sum())

    def found(self) -> list[float]:
        return [self.approx, *(level.energy for level in reversed(self.levels))]


def wavelet_features(points: DataFrame, fps: float = 10.0, min_points: int = 15) -> DataFrame:
    """Energies of the speed's wavelet decomposition and their entropy; detail1 is the coarsest.

    Tracks are dealt out and sorted once and go through the filters of all levels piece by
    piece, so that a task holds a batch and a few samples, however long its tracks are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        track, state, seen = None, None, 0
        for batch in batches:
            video, name, i, a, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            cuts = np.flatnonzero(np.r_[True, (video[1:] != video[:-1]) | (name[1:] != name[:-1]), True]) if len(i) else []
            out = []
            for begin, end in zip(cuts, cuts[1:]):
                if track != (video[begin], name[begin]):
                    track, state, seen = (video[begin], name[begin]), _Energies(), 0
                seen += end - begin
                state.push(a[begin:end], seen == n[begin])
                if seen == n[begin]:
                    out.append((int(video[begin]), int(name[begin]), *state.found()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], [*TRACK, *WAVELET[:4]])

    order, track = Window.partitionBy(*TRACK).orderBy("seq", "x", "y"), Window.partitionBy(*TRACK)
    moved = [F.col(c).cast("double") - F.lag(F.col(c).cast("double")).over(order) for c in ("x", "y")]
    speed = F.coalesce(F.hypot(*moved), F.lit(float("nan"))) * fps
    steps = points.select(*TRACK, (F.row_number().over(order) - 2).cast("long").alias("i"), speed.alias("a"), (F.count("*").over(track) - 1).alias("len"))
    padded = _padded(steps.where((F.col("i") >= 0) & (F.col("len") + 1 >= max(min_points, 2))))
    rows = padded.select(*(F.col(c).cast("long").alias(c) for c in TRACK), "i", "a", "n").repartition(*TRACK).sortWithinPartitions(*TRACK, "i")
    sums = rows.mapInArrow(run, ", ".join(["video_id long, track_id long", *(f"{c} double" for c in WAVELET[:4])]))
    total = F.col(WAVELET[0]) + F.col(WAVELET[1]) + F.col(WAVELET[2]) + F.col(WAVELET[3])
    share = [F.col(e) / (total + 1e-10) for e in WAVELET[:4]]
    entropy = -sum((p * F.log(p + 1e-10) for p in share), F.lit(0.0))
    return sums.select(*TRACK, *WAVELET[:4], total.alias(WAVELET[4]), entropy.alias(WAVELET[5]))
