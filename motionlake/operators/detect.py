"""Detections: per-frame and per-video statistics, box overlap, distances, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import distance, iou

BOX = ("x", "y", "w", "h")


def sample_step(frame_count: int, target: int = 100) -> int:
    """Keep every so many frames to come down to about ``target``."""
    return max(1, frame_count // target) if frame_count > target else 1


def sample_frames(rows: DataFrame, step: int) -> DataFrame:
    return rows.where(F.pmod("frame_no", F.lit(step)) == 0) if step > 1 else rows


def min_area(rows: DataFrame, least: int = 500) -> DataFrame:
    return rows.where(F.col("w") * F.col("h") >= least)


def detection_stats(detections: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """Per video: frames, mean, deviation and maximum of detections a frame, frames without any, total.

    ``frames`` (video_id, frame_no) lists the frames processed; without it they are
    those with a detection.
    """
    per = detections.groupBy("video_id", "frame_no").agg(F.count("*").alias("n"))
    if frames is not None:
        per = frames.select("video_id", "frame_no").distinct().join(per, ["video_id", "frame_no"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return per.groupBy("video_id").agg(F.count("*").alias("n_frames"), F.avg("n").alias("mean_per_frame"), F.stddev_pop("n").alias("std_per_frame"), F.max("n").alias("max_per_frame"), F.count_if(F.col("n") == 0).alias("zero_frames"), F.sum("n").alias("total"))


def _next_frame(detections: DataFrame) -> DataFrame:
    """Pairs of boxes of one video in consecutive frames: an equi-join on (video, frame)."""
    a, b = detections.alias("a"), detections.alias("b")
    return a.join(b, (F.col("a.video_id") == F.col("b.video_id")) & (F.col("a.frame_no") + 1 == F.col("b.frame_no")))


def iou_pairs(detections: DataFrame, above: float = 0.3) -> DataFrame:
    """Boxes of consecutive frames that overlap by more than ``above``."""
    pairs = _next_frame(detections).withColumn("iou", iou(*(F.col(f"{t}.{c}") for t in "ab" for c in BOX))).where(F.col("iou") > above)
    return pairs.select(F.col("a.video_id").alias("video_id"), F.col("a.frame_no").alias("frame_no"), F.col("a.det_id").alias("det_a"), F.col("b.det_id").alias("det_b"), "iou")


def nearest_next(detections: DataFrame, k: int = 2) -> DataFrame:
    """Per box, the k boxes of the next frame with the nearest centre; ties by id."""
    centre = lambda t, p, s: F.col(f"{t}.{p}") + F.floor(F.col(f"{t}.{s}") / 2)
    d = distance((centre("a", "x", "w") - centre("b", "x", "w")).cast("double"), (centre("a", "y", "h") - centre("b", "y", "h")).cast("double"))
    pairs = _next_frame(detections).select(F.col("a.video_id").alias("video_id"), F.col("a.frame_no").alias("frame_no"), F.col("a.det_id").alias("det_a"), F.col("b.det_id").alias("det_b"), d.alias("distance"))
    place = F.row_number().over(Window.partitionBy("video_id", "frame_no", "det_a").orderBy("distance", "det_b"))
    return pairs.withColumn("place", place.cast("long")).where(F.col("place") <= k)


def normalised_boxes(detections: DataFrame, manifest: DataFrame) -> DataFrame:
    """Boxes as shares of their video's width and height, in millionths, halves rounded up.

    They are rounded as whole numbers, so that no binary fraction decides.
    """
    sizes = manifest.select("video_id", "width", "height")
    share = lambda c, by: (F.expr(f"(2000000 * {c} + {by}) div (2 * {by})") / 1e6).alias(f"n{c}")
    return detections.join(sizes, "video_id").select("video_id", "det_id", share("x", "width"), share("y", "height"), share("w", "width"), share("h", "height"))


def sequence_index(n: Column, size: int) -> Column:
    """``size`` frame numbers spread evenly over n frames; with fewer frames, all and the last again."""
    even = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.floor(i * (n - 1) / (size - 1)))
    short = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.least(i.cast("long"), n - 1))
    return F.when(n >= size, even).otherwise(short)


def clip_indices(detections: DataFrame, size: int = 16) -> DataFrame:
    """Per video, the frames of a clip of fixed length."""
    n = detections.groupBy("video_id").agg((F.max("frame_no") + 1).alias("n_frames"))
    return n.select("video_id", "n_frames", F.posexplode(sequence_index(F.col("n_frames"), size)).alias("slot", "frame_no"))
