"""Boxes of one frame matched to those of the next, as joins.

Boxes that overlap each other and nothing else are settled by joins alone. Only what is
ambiguous goes to an optimal assignment, a frame's overlapping boxes at a time; boxes that
don't overlap add nothing to an assignment, so leaving them out changes no optimum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import iou
from ..functions.kernels import assign
from .reuse import written

PAIR = ["video_id", "frame_no", "det_id", "next_det"]


def overlaps(detections: DataFrame) -> DataFrame:
    """video_id, frame_no, det_id, next_det, iou of boxes that overlap boxes of the next frame number."""
    boxes = detections.select("video_id", "frame_no", "det_id", *(F.col(c).cast("double").alias(c) for c in "xywh"))
    after = boxes.select("video_id", (F.col("frame_no") - 1).alias("frame_no"), F.col("det_id").alias("next_det"), *(F.col(c).alias(f"b{c}") for c in "xywh"))
    share = iou(*(F.col(c) for c in "xywh"), *(F.col(f"b{c}") for c in "xywh"))
    return boxes.join(after, ["video_id", "frame_no"]).select(*PAIR, share.alias("iou")).where("iou > 0")


def split(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs whose two boxes have no other pair, and the rest."""
    here = pairs.groupBy("video_id", "frame_no", "det_id").agg(F.count("*").alias("_a"))
    there = pairs.groupBy("video_id", "frame_no", "next_det").agg(F.count("*").alias("_b"))
    counted = pairs.join(here, PAIR[:3]).join(there, ["video_id", "frame_no", "next_det"])
    lone = (F.col("_a") == 1) & (F.col("_b") == 1)
    return counted.where(lone).drop("_a", "_b"), counted.where(~lone).drop("_a", "_b")


def settled(detections: DataFrame, above: float = 0.3) -> DataFrame:
    """The matches of more than ``above`` that need no assignment."""
    return split(overlaps(detections))[0].where(F.col("iou") > above).select(*PAIR, "iou")


def matched(detections: DataFrame, above: float = 0.3) -> DataFrame:
    """video_id, frame_no, det_id, next_det, iou, settled: of the assignment of greatest overlap from each
    frame to the next its pairs of more than ``above``; a box is in one pair on either side.

    Frames without a following number have none; of equal assignments the one with the
    earlier boxes. Detections are unique by video, frame and det_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for video, frame, pairs in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                a, b = ({d: i for i, d in enumerate(sorted({p[k] for p in pairs}))} for k in ("det_id", "next_det"))
                share = np.zeros((len(a), len(b)))
                for p in pairs:
                    share[a[p["det_id"]], b[p["next_det"]]] = p["iou"]
                one, two = list(a), list(b)
                out += [(video, frame, one[i], two[j], float(share[i, j])) for i, j in assign(-share) if share[i, j] > above]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate([pa.int64()] * 4 + [pa.float64()])], [*PAIR, "iou"])

    alone, rest = split(written(overlaps(detections), "overlaps"))
    frames = rest.groupBy("video_id", "frame_no").agg(F.collect_list(F.struct("det_id", "next_det", "iou")).alias("pairs"))  # of one frame's boxes
    frames = frames.select(F.col("video_id").cast("long").alias("video_id"), F.col("frame_no").cast("long").alias("frame_no"), "pairs")
    solved = frames.mapInArrow(run, ", ".join([*(f"{c} long" for c in PAIR), "iou double"]))
    kept = alone.where(F.col("iou") > above).select(*(F.col(c).cast("long").alias(c) for c in PAIR), "iou")
    return kept.withColumn("settled", F.lit(True)).unionByName(solved.withColumn("settled", F.lit(False)))
