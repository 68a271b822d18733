"""A configuration as a plan: from frames to one feature row per video, and the records of a run."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from functools import partial
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..learning import training
from ..operators import dataset, preprocess, shapes, tracking, tracks, vision
from ..operators.reuse import written
from ..sources import files

CONFIGS = str(Path(__file__).resolve().parents[1] / "configs")
FAMILIES: dict[str, tuple[Callable[..., DataFrame], list[str]]] = {
    "trajectory": (tracks.trajectory_features, tracks.TRAJECTORY),
    "circular_motion": (tracks.circular_features, tracks.CIRCULAR),
    "kinematics": (tracks.kinematics_features, tracks.KINEMATICS),
    "shape": (shapes.shape_features, shapes.SHAPE),
    "wavelet": (shapes.wavelet_features, shapes.WAVELET),
    "interaction": (tracks.interaction_features, tracks.INTERACTION),
}


def names() -> list[str]:
    """The configurations that come with the library."""
    return sorted(p.stem for p in Path(CONFIGS).glob("*.yaml"))


def load(name: str, overrides: dict[str, Any] | None = None, folder: str = CONFIGS) -> dict[str, Any]:
    return files.load_config(name, folder, overrides)


def build_preprocessor(config: dict[str, Any]) -> Callable[[DataFrame], DataFrame]:
    """Frames to frames with diagnostics, by preprocessing.type and frame_resize (width, height)."""
    own = config.get("preprocessing", {})
    width, height = own.get("frame_resize", (640, 480))
    return lambda frames: preprocess.preprocess(frames, own.get("type", "standard"), height, width)


def _detector_settings(config: dict[str, Any]) -> dict[str, Any]:
    own = config.get("detection", {})
    kind = own.get("type", "mog2")
    given = own.get("mog2" if kind == "ground_truth" else kind)
    rename = {"var_threshold": "threshold", "detect_shadows": "shadows"}
    return {rename.get(k, k): v for k, v in given.items()} if isinstance(given, dict) else {}


def build_detector(config: dict[str, Any], known: DataFrame | None = None) -> Callable[[DataFrame], DataFrame]:
    """Frames to boxes, by detection.type.

    ``ground_truth`` takes the boxes of ``known`` (video_id, frame_no, x, y, w, h) and, for
    the videos that it has none of, the background model.
    """
    own = config.get("detection", {})
    kind, area, how = own.get("type", "mog2"), own.get("min_contour_area", 500), _detector_settings(config)
    if kind != "ground_truth":
        return lambda frames: vision.detect(frames, kind, area, **how)
    if known is None:
        raise ValueError("detection.type ground_truth needs known boxes")

    def found(frames: DataFrame) -> DataFrame:
        told = known.select("video_id").distinct()
        return vision.ground_truth(frames, known).unionByName(vision.detect(frames.join(told, "video_id", "left_anti"), "mog2", area, **how))

    return found


def build_tracker(config: dict[str, Any]) -> Callable[[DataFrame], DataFrame]:
    """Boxes to tracked boxes, by tracking.type."""
    kind, how = _tracker_settings(config)
    return lambda boxes: tracking.track(boxes, kind, **how)


def _tracker_settings(config: dict[str, Any]) -> tuple[str, dict[str, Any]]:
    own = config.get("tracking", {})
    kind = own.get("type", "iou_hungarian")
    how = {"max_gap": own.get("max_disappeared", tracking.MAX_GAP)}
    if kind != "centroid":
        how["above"] = own.get("iou_threshold", 0.3)
    return kind, how


def build_tracked(config: dict[str, Any], known: DataFrame | None = None) -> Callable[[DataFrame], DataFrame]:
    """Frames to tracked boxes.

    The detector that follows its tracker's success runs with it step by step; the tracker
    by appearance gets the looks of the boxes; all others run one after the other.
    """
    kind, how = _tracker_settings(config)
    own = config.get("detection", {})
    if own.get("type") == "adaptive_mog2" and kind != "tfcr":

        def together(frames: DataFrame) -> DataFrame:
            found = vision.detect_and_track(frames, "adaptive_mog2", kind, own.get("min_contour_area", 500), _detector_settings(config), how).where("note is null")
            centre = {f"c{a}": (F.col(a) + F.floor(F.col(s) / 2)).cast("long") for a, s in (("x", "w"), ("y", "h"))}
            return found.select("video_id", "frame_no", "det_id", "track_id", "hits", *(c.alias(n) for n, c in centre.items()))

        return together
    detect = build_detector(config, known)
    if kind == "tfcr":
        return lambda frames: build_tracker(config)(preprocess.appearance(frames, written(detect(frames), "boxes")))
    return lambda frames: build_tracker(config)(detect(frames))


def build_features(config: dict[str, Any]) -> Callable[[DataFrame], DataFrame]:
    """Track points to one row per video: pooled features of features.modules and temporal context.

    tracking.min_trajectory_len is the least length of a track for the families that ask for one.
    """
    least = config.get("tracking", {}).get("min_trajectory_len")
    modules = config.get("features", {}).get("modules", [])
    if wrong := [m for m in modules if m not in FAMILIES]:
        raise KeyError(f"no features {wrong}; there are {sorted(FAMILIES)}")

    def pooled(points: DataFrame) -> DataFrame:
        per, own = None, []
        for m in modules:
            f, cols = FAMILIES[m]
            if least is not None and "min_points" in inspect.signature(f).parameters:
                f = partial(f, min_points=least)
            per = f(points) if per is None else per.join(f(points), tracks.TRACK, "full")
            own += cols
        context = tracks.temporal_context(points)
        return context if per is None else tracks.pool(per, own).join(context, "video_id")

    return pooled


def video_vectors(frames: DataFrame, config: dict[str, Any], known: DataFrame | None = None) -> DataFrame:
    """One row per video of ``frames``: features of its living tracks, 0 and an indicator of 0.0 where it has none."""
    own = config.get("tracking", {})
    ready = build_preprocessor(config)(frames).select("video_id", "frame_no", "height", "width", "pixels")
    tracked = written(build_tracked(config, known)(ready), "tracked")
    points = written(tracking.alive(tracked, frames, own.get("max_disappeared", tracking.MAX_GAP), most=own.get("max_trajectory_len", tracking.MAX_POINTS)), "points")
    features = build_features(config)(points)
    if "n_valid_tracks" not in features.columns:
        features = features.withColumn("n_valid_tracks", F.col("temporal_n_tracks").cast("long"))
    return dataset.with_indicators(features, frames.select(F.col("video_id").cast("long").alias("video_id")).distinct())


def train(vectors: DataFrame, labels: DataFrame, config: dict[str, Any], target: str, out: str | None = None) -> dict[str, Any]:
    """Train and evaluate models.active for one of targets; ``labels`` has video_id and the target.

    Videos without a label are left out. training, smoothing and experiment.seed are read.
    """
    if target not in config.get("targets", [target]):
        return {"viable": False, "error": f"{target} is no target of this configuration"}
    rows = vectors.join(labels.where(F.col(target).isNotNull()).select("video_id", F.col(target).cast("string").alias(target)).dropDuplicates(["video_id"]), "video_id")
    seed = config.get("experiment", {}).get("seed", 42)
    return training.train_and_evaluate(rows, target, config.get("models", {}).get("active", []), training=config.get("training"), smoothing=config.get("smoothing"), seed=seed, out=out)
