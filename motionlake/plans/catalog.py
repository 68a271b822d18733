"""The registered motion queries; ``oracle`` has the same queries as SQL.

Each takes (spark, sf_dir), reads the whole tables through the views, and rounds
doubles so that results compare across engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import tables
from ..functions.columns import rounded
from ..operators import dataset, detect, frames, learn, matching, shapes, tracks, vision
from ..sources import files, views
from ..streaming import events as event_windows
from . import learned, oracle, programs


def tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded to six digits, whole numbers as long."""
    kind = {f.name: f.dataType for f in df.schema}
    out = {n: rounded(n) for n, t in kind.items() if isinstance(t, T.DoubleType)} | {n: F.col(n).cast("long") for n, t in kind.items() if isinstance(t, (T.IntegerType, T.DecimalType))}
    return df.withColumns(out) if out else df


def _points(f, *a, **k):
    return lambda spark, d: f(views.track_points(spark, d), *a, **k)


def _lengths(f, *a, **k):
    return lambda spark, d: f(tracks.lengths(views.track_points(spark, d)), *a, **k)


def _frames(f):
    return lambda spark, d: f(views.frames(spark, d))


def _video():
    return views.frame_video()


def _quality(spark, d):
    return frames.quality(views.frames(spark, d))


def _steps(spark, d):
    return tracks.steps(views.track_points(spark, d)).where("dx is not null").select("video_id", F.col("seq").alias("frame_no"), "dx", "dy")


def _outcomes(spark, d):
    points = views.track_points(spark, d)
    features = tracks.pool(tracks.kinematics_features(points), tracks.KINEMATICS)
    return dataset.video_outcomes(views.manifest(spark, d), views.detections(spark, d), tracks.lengths(points), features=features)


def _metrics(spark, d):
    return tracks.tracker_metrics(tracks.missed_frames(views.track_points(spark, d)))


def _blobs(spark, d):
    boxes = detect.min_area(views.detections(spark, d))
    area = F.col("w") * F.col("h")
    per = boxes.groupBy("video_id", "frame_no").agg((F.sum(area) / 307200.0).alias("coverage"), F.count("*").alias("n_blobs"), F.percentile(area, F.lit(0.5)).alias("median_area"))
    scored = frames.mask_score(per, 307200.0)
    return scored.withColumn("threshold", frames.relaxed_threshold(F.col("score"), 0.4, 16.0, 10.0, 8.0))


def _knn(spark, d):
    vectors = views.table(spark, d, "embeddings")
    return learn.nearest(vectors, vectors)


def _knn_votes(spark, d):
    vectors = views.table(spark, d, "embeddings").select("vec_id", "label")
    near = _knn(spark, d).join(vectors, F.col("other") == F.col("vec_id")).select("id", "label")
    voted = learn.vote(near)
    return voted.join(vectors.select(F.col("vec_id").alias("id"), F.col("label").alias("truth")), "id")


def _predictions(spark, d):
    """Out-of-fold labels of three nearest-mean models: of all dimensions, of the first and of the last half."""
    return _models(spark, d, False).select("id", "truth", "model", F.col("predicted").alias("label"))


def _models(spark, d, train):
    vectors, out = views.table(spark, d, "embeddings"), None
    for name, dims in {"all": None, "first": (0, 32), "last": (32, 64)}.items():
        part = learn.fold_predictions(vectors, dims=dims, order=F.col("vec_id"), train=train).withColumn("model", F.lit(name))
        out = part if out is None else out.union(part)
    return out


def _ema_vote(spark, d):
    said = _predictions(spark, d)
    accuracy = said.groupBy("model").agg(F.avg((F.col("label") == F.col("truth")).cast("double")).alias("accuracy"))
    weights = learn.model_weights(accuracy, 0.7)
    return learn.vote(said.join(F.broadcast(weights), "model"), weight=F.round("weight", 9))


def _ema_quality(spark, d):
    points = views.track_points(spark, d).withColumn("raw", F.col("y") / 100)
    return tracks.ema_quality(points)


def _frame_rolling(spark, d):
    change = frames.frame_difference(views.frames(spark, d), _video())
    return frames.rolling_threshold(change.select("video_id", "frame_no", "mean_change"), "mean_change")


def _folds(spark, d):
    rows = views.table(spark, d, "embeddings").select("vec_id", "label")
    dealt = learn.stratified_folds(rows, "label", "vec_id", order=F.col("vec_id"))
    return dealt.groupBy("fold", "label").agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids"))


def _cv_summary(spark, d):
    return learn.cv_summary(_models(spark, d, True))


def _long_features(spark, d):
    """Features of videos as rows (video_id, key, value), with some keys that are none."""
    points = views.track_points(spark, d)
    wide = tracks.pool(tracks.curvature_features(points), tracks.CURVATURE).join(tracks.temporal_context(points), "video_id")
    named = wide.select("video_id", *(F.col(c).cast("double").alias(c) for c in wide.columns if c != "video_id"), F.lit(1.0).alias("feature_count"))
    long = named.unpivot("video_id", [c for c in named.columns if c != "video_id"], "key", "value").where("value is not null")
    return long.where(~((F.col("video_id") % 3 == 1) & F.col("key").startswith("temporal")))  # some videos lack a family


#: The features that feature_matrix lays out; a fixed list, as a fitted model has.
_MATRIX = ["mean_curvature_mean", "mean_curvature_max", "path_efficiency_mean", "temporal_n_tracks", "temporal_mean_track_len"]


def _vector(spark, d, families):
    """One row per video: all pooled features of ``families``, temporal context, metadata and indicators."""
    points = views.track_points(spark, d)
    made = {"trajectory": (tracks.trajectory_features, tracks.TRAJECTORY), "circular_motion": (tracks.circular_features, tracks.CIRCULAR), "kinematics": (tracks.kinematics_features, tracks.KINEMATICS), "shape": (shapes.shape_features, shapes.SHAPE), "wavelet": (shapes.wavelet_features, shapes.WAVELET), "interaction": (tracks.interaction_features, tracks.INTERACTION)}
    per, names = None, []
    for family in families:
        f, own = made[family]
        per = f(points) if per is None else per.join(f(points), tracks.TRACK, "full")
        names += own
    pooled = tracks.pool(per, names).join(tracks.temporal_context(points), "video_id")
    seen = points.groupBy("video_id").agg((F.max("seq") + 1).alias("n_frames"))
    return _coarse(dataset.with_metadata(dataset.with_indicators(pooled, seen).join(seen, "video_id"), views.manifest(spark, d)).drop("n_frames"), 0)


def _coarse(df, digits):
    """Wavelet energies, which are large, rounded to fewer digits, so that they compare across engines."""
    return df.withColumns({c: F.round(c, digits) for c in df.columns if c.startswith("dwt_energy")})


def _ground_truth(spark, d):
    boxes = views.detections(spark, d)
    known = boxes.where("det_id % 3 = 0")  # the boxes that a text names
    found = vision.ground_truth(detect.sample_frames(boxes, 2).select("video_id", "frame_no").distinct(), known)
    return found.select("video_id", "frame_no", "x", "y", "w", "h", "area")


#: Patterns of a video's ground-truth text, the earliest that fits wins.
_PATTERNS = ["%_gt.txt", "%groundtruth%", "%.txt"]


def _truth_files(spark, d):
    names = views.manifest(spark, d)
    kinds = F.array(F.lit(".txt"), F.when(F.col("video_id") % 2 == 0, "_groundtruth.csv"), F.when(F.col("video_id") % 3 == 0, "_gt.txt"), F.when(F.col("video_id") % 5 == 0, "_a_gt.txt"), F.lit(".mp4"))
    listed = names.select("video_id", "series_name", F.explode(kinds).alias("end")).where("end is not null and (video_id % 7 > 0 or end = '.mp4')")
    return files.first_match(listed.select("video_id", F.concat("series_name", "end").alias("file")), _PATTERNS)


def _sql_track_features(spark, d):
    tables.register(spark)
    return spark.sql("SELECT * FROM track_features(TABLE({points}) PARTITION BY (video_id, track_id) ORDER BY seq)", points=views.track_points(spark, d))


def _sql_boxes(spark, d):
    tables.register(spark)
    boxes = views.detections(spark, d)
    both = ", ".join(f"{s}.{c}" for s in "ab" for c in "xywh")
    return spark.sql(f"""
        SELECT a.video_id, a.frame_no, a.det_id AS det_a, b.det_id AS det_b, box_iou({both}) AS iou, centre_distance({both}) AS distance
        FROM {{boxes}} a JOIN {{boxes}} b ON a.video_id = b.video_id AND a.frame_no + 1 = b.frame_no WHERE box_iou({both}) > 0.3""", boxes=boxes)


_RAW = {
    "trajectory_track": _points(tracks.trajectory_features),
    "trajectory_video": lambda s, d: tracks.pool(tracks.trajectory_features(views.track_points(s, d)), tracks.TRAJECTORY),
    "circular_motion": _points(tracks.circular_features),
    "kinematics": _points(tracks.kinematics_features),
    "shape_curvature": _points(tracks.curvature_features),
    "dense_trajectory": _points(tracks.dense_features),
    "interaction": _points(tracks.interaction_features),
    "temporal_context": _points(tracks.temporal_context),
    "tracker_metrics": _metrics,
    "length_percentiles": _lengths(tracks.length_percentiles),
    "length_retention": _lengths(tracks.length_retention),
    "length_histogram": _lengths(tracks.length_histogram),
    "track_confidence": _lengths(tracks.track_confidence),
    "trajectory_cap": _points(tracks.cap_trajectory, 20),
    "ema_track_quality": _ema_quality,
    "detection_stats": lambda s, d: detect.detection_stats(detect.min_area(views.detections(s, d), 1500), views.detections(s, d)),
    "iou_pairs": lambda s, d: detect.iou_pairs(views.detections(s, d)),
    "sql_track_features": _sql_track_features,
    "sql_boxes": _sql_boxes,
    "settled_matches": lambda s, d: matching.settled(views.detections(s, d)),
    "centroid_distance_topk": lambda s, d: detect.nearest_next(views.detections(s, d)),
    "bbox_normalise": lambda s, d: detect.normalised_boxes(views.detections(s, d), views.manifest(s, d)),
    "frame_sampling": lambda s, d: detect.sample_frames(views.detections(s, d), 5),
    "clip_indices": lambda s, d: detect.clip_indices(views.detections(s, d)),
    "resolution_stats": lambda s, d: dataset.resolution_stats(views.manifest(s, d)),
    "fps_duration_stats": lambda s, d: dataset.value_stats(views.manifest(s, d)),
    "min_length_report": lambda s, d: dataset.min_length_report(views.manifest(s, d)),
    "sampling_steps": lambda s, d: dataset.sampling_steps(views.manifest(s, d)),
    "group_manifest": lambda s, d: dataset.groups(views.manifest(s, d)),
    "group_names": lambda s, d: dataset.group_names(views.manifest(s, d), ("activity",)),
    "distinct_distortions": lambda s, d: dataset.distinct_values(views.manifest(s, d)),
    "group_sample": lambda s, d: dataset.sample_per_group(views.manifest(s, d), 2, order=F.col("video_id")),
    "missing_videos_anti": lambda s, d: dataset.missing(views.manifest(s, d), views.detections(s, d)).select("video_id", "series_name"),
    "existing_videos_semi": lambda s, d: dataset.existing(views.manifest(s, d), views.detections(s, d)).select("video_id", "series_name"),
    "manifest_left_join": lambda s, d: dataset.with_metadata(detect.detection_stats(views.detections(s, d)).select("video_id", "n_frames"), views.manifest(s, d)),
    "failure_reason": lambda s, d: _outcomes(s, d).select("video_id", "n_det", "n_frames", "n_tracks", "longest", "reason"),
    "detector_stats_by_group": lambda s, d: dataset.outcome_stats(_outcomes(s, d)),
    "failures_by_class": lambda s, d: dataset.failures_by_class(_outcomes(s, d)),
    "run_summary": lambda s, d: dataset.run_summary(_outcomes(s, d)),
    "failure_taxonomy": lambda s, d: _outcomes(s, d).where("reason is not null").select("series_name", "activity", "distortion", "reason"),
    "feature_keys": lambda s, d: dataset.feature_keys(_long_features(s, d)),
    "missing_feature_keys": lambda s, d: dataset.missing_keys(_long_features(s, d)),
    "feature_matrix": lambda s, d: dataset.feature_matrix(_long_features(s, d), _MATRIX),
    "clip_dataset": lambda s, d: dataset.clip_dataset(views.manifest(s, d), views.detections(s, d), per_class=3),
    "augmentation_plan": lambda s, d: dataset.augmentation_plan(views.manifest(s, d)),
    "ground_truth_boxes": _ground_truth,
    "ground_truth_files": _truth_files,
    "shape_features": _points(shapes.shape_features),
    "hull_features": _points(shapes.hull_features),
    "wavelet_features": lambda s, d: _coarse(shapes.wavelet_features(views.track_points(s, d)), 2),
    "video_vector_a": lambda s, d: _vector(s, d, ["trajectory"]),
    "video_vector_all": lambda s, d: _vector(s, d, ["trajectory", "circular_motion", "kinematics", "shape", "wavelet", "interaction"]),
    "class_distribution": lambda s, d: learn.class_distribution(views.table(s, d, "embeddings")),
    "class_weights": lambda s, d: learn.class_weights(views.table(s, d, "labels"), "toxic"),
    "training_viability": lambda s, d: learn.training_viability(views.table(s, d, "embeddings")),
    "label_encode": lambda s, d: learn.encode_labels(views.table(s, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment"),
    "stratified_folds": _folds,
    "stratified_holdout": lambda s, d: learn.holdout(views.table(s, d, "embeddings").select("vec_id", "label"), "label", "vec_id", order=F.col("vec_id")),
    "zscore": lambda s, d: learn.zscores(views.table(s, d, "embeddings")),
    "knn": _knn,
    "knn_vote": _knn_votes,
    "confusion_matrix": lambda s, d: learn.confusion(_knn_votes(s, d)),
    "weighted_f1": lambda s, d: learn.scores(_knn_votes(s, d)),
    "cv_summary": _cv_summary,
    "majority_vote": lambda s, d: learn.vote(_predictions(s, d)),
    "ema_vote": _ema_vote,
    "top_features": lambda s, d: learn.between_class_ratio(views.table(s, d, "embeddings")),
    "frame_quality": _quality,
    "distortion_label": lambda s, d: frames.distortion_label(_quality(s, d)).select("frame_no", "distortion_type", "is_blurry", "blur_score"),
    "diagnostic_pool": lambda s, d: frames.pool_quality(_quality(s, d), _video()),
    "lbp_uniform": lambda s, d: frames.pool_bins(frames.texture(views.frames(s, d)), _video()),
    "orientation_hist": lambda s, d: frames.pool_bins(frames.orientation(views.frames(s, d)), _video()),
    "frame_diff_threshold": lambda s, d: frames.frame_difference(views.frames(s, d), _video()),
    "rolling_flow_threshold": _frame_rolling,
    "mask_score": _blobs,
    "flow_pool": lambda s, d: frames.flow_pool(_steps(s, d)),
    "tumbling_event_counts": lambda s, d: event_windows.tumbling_counts(views.table(s, d, "events")),
    "sliding_event_values": lambda s, d: event_windows.sliding_values(views.table(s, d, "events")),
    "session_events": lambda s, d: event_windows.sessions(views.table(s, d, "events")),
}


def _tidied(f):
    return lambda spark, sf_dir: tidy(f(spark, sf_dir))


QUERIES = {name: _tidied(f) for name, f in _RAW.items()} | programs.QUERIES | learned.QUERIES
ORACLE_SQL: dict[str, str] = oracle.SQL | learned.SQL
