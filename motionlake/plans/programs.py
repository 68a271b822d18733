"""Queries that SQL can't state: trackers, kernels, detectors and learned models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detect, frames, matching, models, preprocess, shapes, tracking, tracks, vision
from ..operators.reuse import written
from ..registry import CATEGORIES, available, build, is_registered, register
from ..sources import views
from . import configured

for _name in tracking.TRACKERS:
    if not is_registered("tracker", _name):
        register("tracker", _name)(lambda detections, kind=_name, **how: tracking.track(detections, kind, **how))
for _name in (*vision.DETECTORS, vision.Cascade.name):
    if not is_registered("detector", _name):
        register("detector", _name)(lambda frames, kind=_name, **how: vision.detect(frames, kind, **how))
for _name in preprocess.KINDS:
    if not is_registered("preprocessor", _name):
        register("preprocessor", _name)(lambda f, kind=_name, **how: preprocess.preprocess(f, kind, **how))
if not is_registered("detector", "ground_truth"):
    register("detector", "ground_truth")(vision.ground_truth)
for _name, _f in {"trajectory": tracks.trajectory_features, "circular_motion": tracks.circular_features, "kinematics": tracks.kinematics_features, "shape": shapes.shape_features, "hull": shapes.hull_features, "wavelet": shapes.wavelet_features, "interaction": tracks.interaction_features}.items():
    if not is_registered("feature", _name):
        register("feature", _name)(_f)


def _tracked(kind: str):
    return lambda spark, d: build("tracker", kind, views.detections(spark, d))


def tracked_video_features(spark, d) -> DataFrame:
    """From detections to one feature row per video: track, keep living tracks, features, pooling, context."""
    boxes = views.detections(spark, d)
    points = written(tracking.alive(written(tracking.track(boxes, "centroid"), "tracked"), boxes), "points")
    pooled = tracks.pool(tracks.trajectory_features(points), tracks.TRAJECTORY)
    return pooled.join(tracks.temporal_context(points), "video_id").join(detect.detection_stats(boxes), "video_id")


def video_pipeline(spark, d) -> DataFrame:
    """From frames to one feature row per video: preprocess, detect, track, features, pooling, flow, quality."""
    seen = frame_bytes(spark, d)
    found = vision.detect(seen, "frame_diff", least_area=4)
    points = written(tracking.alive(written(tracking.track(found, "iou_hungarian"), "tracked"), seen), "points")
    pooled = tracks.pool(tracks.trajectory_features(points), tracks.TRAJECTORY)
    quality = frames.pool_quality(preprocess.preprocess(seen, height=32, width=32).drop("pixels"), F.col("video_id"))
    flow = frames.flow_pool(preprocess.flow_vectors(seen))
    return quality.join(flow, "video_id", "left").join(tracks.temporal_context(points), "video_id", "left").join(pooled, "video_id", "left").na.fill(0.0)


def tracking_ablation(spark, d) -> DataFrame:
    """Tracker metrics per video of every tracker over the same detections, stepped in one pass."""
    boxes = views.detections(spark, d)
    ends = boxes.groupBy("video_id").agg(F.max("frame_no").alias("end"))
    per = tracking.track_all(boxes).groupBy("tracker", "video_id", "track_id").agg(F.count("*").alias("n"), F.max("frame_no").alias("last")).join(ends, "video_id")
    gone = F.col("end") - F.col("last")
    living = per.where(gone <= tracking.MAX_GAP).select("tracker", "video_id", "track_id", F.least("n", F.lit(tracking.MAX_POINTS)).alias("len"), gone.alias("disappeared"), (F.col("end") + 1).alias("frames"))
    return tracks.tracker_metrics(living, ("video_id", "tracker"))


def frame_bytes(spark, d) -> DataFrame:
    """The gray frames of the views as bytes, each enlarged four times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            small = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.uint8).reshape(-1, 8, 8)
            big = small.repeat(4, 1).repeat(4, 2)
            size = pa.array([32] * len(big), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), size, size, pa.array([f.tobytes() for f in big], pa.binary())], ["video_id", "frame_no", "height", "width", "pixels"])

    return views.frames(spark, d).select(views.frame_video().cast("long").alias("video_id"), F.col("frame_no").cast("long").alias("frame_no"), "pixels").mapInArrow(run, preprocess.FRAME)


def _by_appearance(spark, d) -> DataFrame:
    found = vision.detect(frame_bytes(spark, d), "frame_diff", least_area=4)
    return tracking.track(preprocess.appearance(frame_bytes(spark, d), found), "tfcr")


_DIMS = [f"f{i}" for i in range(64)]


def _labelled(spark, d) -> DataFrame:
    return views.table(spark, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"), *(F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(_DIMS)))


def _model_predictions(name: str):
    return lambda spark, d: models.out_of_fold(_labelled(spark, d), _DIMS, "label", "vec_id", lambda: build("model", name), order=F.col("vec_id"))


def _adaptive(spark, d) -> DataFrame:
    return vision.detect_and_track(frame_bytes(spark, d), "adaptive_mog2", "centroid", least_area=4)


def _by_scales(spark, d) -> DataFrame:
    seen, scales = frame_bytes(spark, d), (0.95, 1.0, 1.05)
    found = vision.detect(seen, "frame_diff", least_area=4)
    return tracking.track(preprocess.appearance(seen, found, scales), "tfcr", scales=scales)


def _components(spark, d) -> DataFrame:
    """The components that work alone, as its SQL has them; the command line lists the stages of saved pipelines too."""
    rows = [(c, n) for c in CATEGORIES for n in available(c, alone=True)]
    return spark.createDataFrame(rows, "category string, name string")


QUERIES = {
    **{f"track_{k}": _tracked(k) for k in tracking.TRACKERS},
    "frame_matches": lambda s, d: matching.matched(views.detections(s, d)),
    "video_pipeline": video_pipeline,
    "tracking_ablation": tracking_ablation,
    "tracked_video_features": tracked_video_features,
    **{f"detect_{k}": (lambda s, d, k=k: vision.detect(frame_bytes(s, d), k, least_area=4)) for k in (*vision.DETECTORS, vision.Cascade.name)},
    **{f"preprocess_{k}": (lambda s, d, k=k: preprocess.preprocess(frame_bytes(s, d), k, height=48, width=64).drop("pixels")) for k in preprocess.KINDS},
    "optical_flow": lambda s, d: preprocess.mean_flow(preprocess.flow_vectors(frame_bytes(s, d))),
    "global_flow": lambda s, d: frames.flow_pool(preprocess.flow_vectors(frame_bytes(s, d))),
    "keypoints": lambda s, d: preprocess.keypoints(frame_bytes(s, d)),
    "track_by_appearance": _by_appearance,
    "track_by_scales": _by_scales,
    "adaptive_diagnostics": lambda s, d: vision.adaptive_diagnostics(_adaptive(s, d)),
    "adaptive_diagnostics_mean": lambda s, d: vision.diagnostics_means(vision.adaptive_diagnostics(_adaptive(s, d))),
    "cascade_switches": lambda s, d: vision.switch_log(vision.detect_and_track(frame_bytes(s, d), "cascaded_fallback", "iou_hungarian", least_area=1500)),
    "overlay": lambda s, d: vision.overlay(vision.detect_and_track(frame_bytes(s, d), "frame_diff", "iou_hungarian", least_area=4)),
    "dense_descriptors": lambda s, d: preprocess.dense_descriptors(frame_bytes(s, d)),
    "configured_vectors": lambda s, d: configured.video_vectors(frame_bytes(s, d), configured.load("group_b", {"preprocessing": {"frame_resize": [32, 32]}, "detection": {"type": "frame_diff", "min_contour_area": 4}})),
    "model_out_of_fold": _model_predictions("random_forest"),
    "model_decision_tree": _model_predictions("decision_tree"),
    "model_importances": lambda s, d: models.importances(_labelled(s, d), _DIMS, "label", "vec_id", build("model", "decision_tree")),
    "model_probabilities": lambda s, d: models.probabilities(_labelled(s, d), _DIMS, "label", "vec_id", build("model", "decision_tree")),
    "components": _components,
}
