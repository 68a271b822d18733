"""Functions for SQL: a table function over tracks, which streams Arrow batches, and box arithmetic as SQL expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

FPS = 10.0
MOTION = ["track_duration_sec", "path_speed_px_s", "net_displacement_speed_px_s", "straightness", "mean_speed_px_s", "max_speed_px_s", "std_speed_px_s", "bbox_area"]
_TYPE = ", ".join(["video_id long", "track_id long", *(f"{n} double" for n in MOTION)])

#: Scalar functions, which Spark expands into the query: name, parameters, result, expression.
_OVERLAP = "greatest(least({a} + {aw}, {b} + {bw}) - greatest({a}, {b}), 0D)"
_BOXES = ", ".join(f"{s}{c} DOUBLE" for s in "ab" for c in "xywh")
_SHARED = f"{_OVERLAP.format(a='ax', aw='aw', b='bx', bw='bw')} * {_OVERLAP.format(a='ay', aw='ah', b='by', bw='bh')}"
SCALARS = {
    "box_iou": (_BOXES, "DOUBLE", f"CASE WHEN aw * ah + bw * bh - {_SHARED} > 0 THEN {_SHARED} / (aw * ah + bw * bh - {_SHARED}) ELSE 0D END"),
    "turn_between": ("a DOUBLE, b DOUBLE", "DOUBLE", "least(abs(a - b), 2 * pi() - abs(a - b))"),
    "centre_distance": (_BOXES, "DOUBLE", "sqrt(pow(ax + floor(aw / 2) - bx - floor(bw / 2), 2) + pow(ay + floor(ah / 2) - by - floor(bh / 2), 2))"),
}


class TrackFeatures:
    """Motion of a track from its points in order; of a track only sums and its first and last point are held."""

    def __init__(self) -> None:
        self.key: tuple | None = None
        self.n, self.moves = 0, 0
        self.path = self.mean = self.square = 0.0
        self.top = 0.0
        self.low, self.high = np.full(2, np.inf), np.full(2, -np.inf)
        self.first = self.last = None

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        xy = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y")], axis=1)
        if len(xy):
            self.key = batch.column("video_id")[0].as_py(), batch.column("track_id")[0].as_py()
            self.n += len(xy)
            self.low, self.high = np.minimum(self.low, xy.min(0)), np.maximum(self.high, xy.max(0))
            chain = xy if self.last is None else np.vstack([self.last, xy])
            self.first = xy[0] if self.first is None else self.first
            self.last = xy[-1]
            self._speeds(np.sqrt((np.diff(chain, axis=0) ** 2).sum(1)))
        return iter(())

    def _speeds(self, v: np.ndarray) -> None:
        """Adds steps to the mean and to the squares about it."""
        if len(v):
            n, gap = self.moves + len(v), v.mean() - self.mean
            self.square += ((v - v.mean()) ** 2).sum() + gap * gap * self.moves * len(v) / n
            self.mean += gap * len(v) / n
            self.moves, self.path, self.top = n, self.path + v.sum(), max(self.top, v.max())

    def terminate(self) -> Iterator[pa.Table]:
        if self.n >= 2:
            seconds, net = self.n / FPS, float(np.sqrt(((self.last - self.first) ** 2).sum()))
            size = self.high - self.low
            row = [seconds, self.path / seconds, net / seconds, net / self.path if self.path > 0 else 0.0, self.mean * FPS, self.top * FPS, float(np.sqrt(self.square / self.moves)) * FPS, float(size[0] * size[1])]
            yield pa.table({"video_id": pa.array([self.key[0]], pa.int64()), "track_id": pa.array([self.key[1]], pa.int64()), **{n: pa.array([float(v)], pa.float64()) for n, v in zip(MOTION, row, strict=True)}})


def register(spark: SparkSession) -> None:
    """Make the functions known to the session.

    ``SELECT * FROM track_features(TABLE(points) PARTITION BY (video_id, track_id) ORDER BY
    seq)`` for points (video_id, track_id, seq, x, y), and ``box_iou``, ``turn_between`` and
    ``centre_distance`` in expressions.
    """
    spark.udtf.register("track_features", arrow_udtf(TrackFeatures, returnType=_TYPE))
    for name, (given, result, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS {result} RETURN {body}")
