"""The video manifest: statistics, groups, samples, joins, failures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio


def most_common(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The most frequent combination; of equals, the smallest."""
    counted = df.groupBy(*cols).agg(F.count("*").alias("n"))
    best = counted.agg(F.min(F.struct((-F.col("n")).alias("n"), *cols)).alias("m"))
    return best.select(*(F.col(f"m.{c}").alias(f"common_{c}") for c in cols))


def resolution_stats(manifest: DataFrame) -> DataFrame:
    """One row over videos with a size: distinct sizes, the most common, and width and height statistics."""
    known = manifest.where("width > 0 and height > 0")
    agg = [F.countDistinct("width", "height").alias("unique_count")]
    for c in ("width", "height"):
        agg += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"std_{c}")]
    return known.agg(*agg).withColumn("all_same", F.col("unique_count") == 1).join(F.broadcast(most_common(known, ["width", "height"])))


def value_stats(manifest: DataFrame, cols: Sequence[str] = ("fps", "duration_s")) -> DataFrame:
    """One row: minimum, maximum, mean, deviation of each column over its positive values."""
    agg = []
    for c in cols:
        v = F.when(F.col(c) > 0, F.col(c))
        agg += [F.min(v).alias(f"min_{c}"), F.max(v).alias(f"max_{c}"), F.avg(v).alias(f"mean_{c}"), F.stddev_pop(v).alias(f"std_{c}"), (F.countDistinct(v) == 1).alias(f"same_{c}")]
    return manifest.agg(*agg)


def min_length_report(manifest: DataFrame, min_len: int = 30) -> DataFrame:
    """Seconds that ``min_len`` frames last at the mean rate, and their share of a mean video in percent."""
    s = value_stats(manifest)
    return s.select((F.lit(float(min_len)) / F.col("mean_fps")).alias("seconds"), (F.lit(float(min_len)) / (F.col("mean_fps") * F.col("mean_duration_s")) * 100).alias("percent_of_video"))


def sampling_steps(manifest: DataFrame, target: int = 100, min_len: int = 30) -> DataFrame:
    """Per video: frames, the step that samples about ``target`` of them, and the reference track length
    ``min(min_len, max(10, int(0.6 frames)))``."""
    n = F.floor(F.col("fps") * F.col("duration_s"))
    step = F.when(F.col("frames") > target, F.greatest(F.lit(1), F.floor(F.col("frames") / target))).otherwise(1)
    least = F.least(F.lit(min_len), F.greatest(F.lit(10), F.floor(F.col("frames") * 0.6)))
    return manifest.withColumn("frames", n).select("video_id", "frames", step.cast("long").alias("step"), least.cast("long").alias("reference_len"))


def groups(manifest: DataFrame, by: Sequence[str] = ("activity", "distortion"), name: str = "series_name") -> DataFrame:
    """Number of videos of each group and its first and last name."""
    return manifest.groupBy(*by).agg(F.count("*").alias("n"), F.min(name).alias("first_name"), F.max(name).alias("last_name"))


def group_names(manifest: DataFrame, by: Sequence[str] = ("activity", "distortion"), name: str = "series_name") -> DataFrame:
    """Each group's names with their place in order, from 1: one row a name, so no group has to fit in a row."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(name, "video_id"))
    return manifest.select(*by, F.col(name).alias("name"), place.cast("long").alias("place"))


def distinct_values(manifest: DataFrame, col: str = "distortion") -> DataFrame:
    """The values of a column, each once, without null."""
    return manifest.where(F.col(col).isNotNull()).select(col).distinct()


def sample_per_group(manifest: DataFrame, n: int, by: Sequence[str] = ("activity", "distortion"), order: Column | None = None) -> DataFrame:
    """The first n rows of each group by ``order`` (default: a hash of the id, a repeatable random sample)."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*([order] if order is not None else [F.xxhash64("video_id")]), "video_id"))
    return manifest.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def missing(manifest: DataFrame, present: DataFrame) -> DataFrame:
    return manifest.join(present.select("video_id").distinct(), "video_id", "left_anti")


def existing(manifest: DataFrame, present: DataFrame) -> DataFrame:
    return manifest.join(present.select("video_id").distinct(), "video_id", "left_semi")


def with_metadata(results: DataFrame, manifest: DataFrame) -> DataFrame:
    """Adds meta_num_frames, meta_duration_sec and meta_fps; frame rate 10 and a length of
    frames / rate where the manifest doesn't say; the first row of a repeated video counts."""
    once = manifest.groupBy("video_id").agg(F.min_by("fps", "series_name").alias("_fps"), F.min_by("duration_s", "series_name").alias("_dur"))
    joined = results.join(once, "video_id", "left")
    fps = F.when(F.col("_fps") > 0, F.col("_fps")).otherwise(10.0)
    return joined.withColumns({"meta_num_frames": F.col("n_frames").cast("double"), "meta_fps": fps, "meta_duration_sec": F.coalesce("_dur", F.col("n_frames") / F.greatest(fps, F.lit(1.0)))}).drop("_fps", "_dur")


def failure_reason(missing_file: Column, detection: Column, too_short: Column, tracking: Column, feature: Column) -> Column:
    """The first reason that holds; null if the video succeeded."""
    return F.when(missing_file, "file_missing").when(detection, "detection_failure").when(too_short, "track_too_short").when(tracking, "tracking_failure").when(feature, "feature_failure")


def video_outcomes(manifest: DataFrame, detections: DataFrame, track_lengths: DataFrame, min_len: int = 30, features: DataFrame | None = None) -> DataFrame:
    """Per video of the manifest: detections, tracks, frames, longest track, and why it failed.

    ``features`` (video_id, n_valid_tracks) tells the tracks with features; a video that has
    none, or isn't there, though it has tracks, failed in its features.
    """
    det = detections.groupBy("video_id").agg(F.count("*").alias("n_det"), (F.max("frame_no") + 1).alias("n_frames"))
    trk = track_lengths.groupBy("video_id").agg(F.count("*").alias("n_tracks"), F.max("len").alias("longest"), F.sum("len").alias("points"))
    both = manifest.join(det, "video_id", "left").join(trk, "video_id", "left")
    if features is not None:
        both = both.join(features.select("video_id", "n_valid_tracks"), "video_id", "left")
    reason = failure_reason(F.col("n_frames").isNull(), F.coalesce("n_det", F.lit(0)) == 0, F.col("longest") < min_len, F.coalesce("n_tracks", F.lit(0)) == 0, F.lit(False) if features is None else F.coalesce("n_valid_tracks", F.lit(0)) == 0)
    return both.withColumn("reason", reason)


#: Keys of a result that are no features.
META = ("video", "video_id", "series_name", "activity", "distortion", "n_frames", "feature_count", "reason")


def feature_keys(long: DataFrame, meta: Sequence[str] = META) -> DataFrame:
    """key and its place from 1, in order: the union of all videos' keys without ``meta``; from rows (video_id, key, value)."""
    keys = long.select("key").distinct().where(~F.col("key").isin(*meta))
    return keys.withColumn("place", F.row_number().over(Window.orderBy("key")).cast("long"))  # one row per feature


def missing_keys(long: DataFrame, meta: Sequence[str] = META) -> DataFrame:
    """video_id, key: the union's keys that a video doesn't have, which count as 0.0."""
    ids, keys = long.select("video_id").distinct(), feature_keys(long, meta).select("key")
    return ids.join(keys).join(long.select("video_id", "key"), ["video_id", "key"], "left_anti")


def feature_matrix(long: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per video with a column per name, 0 where it is missing; names are given, so no job finds them."""
    return long.groupBy("video_id").pivot("key", list(names)).agg(F.first("value")).na.fill(0.0, list(names))


def with_indicators(features: DataFrame, manifest_or_results: DataFrame) -> DataFrame:
    """All videos of the second table with their features, indicator_tracks_present (1.0 if the
    video has any valid track) and meta_n_traj_tracks (how many); features of others are 0."""
    names = [c for c in features.columns if c not in ("video_id", "n_valid_tracks")]
    n = F.coalesce(F.col("n_valid_tracks").cast("double"), F.lit(0.0))
    joined = manifest_or_results.select("video_id").join(features, "video_id", "left")
    return joined.withColumns({"meta_n_traj_tracks": n, "indicator_tracks_present": F.when(n > 0, 1.0).otherwise(0.0)}).drop("n_valid_tracks").na.fill(0.0, names)


def clip_dataset(manifest: DataFrame, present: DataFrame, target: str = "activity", per_class: int | None = None) -> DataFrame:
    """Videos for clip models: those that exist, the first ``per_class`` of each class by id, with label and code."""
    from .learn import encode_labels

    rows = existing(manifest, present).where(F.col(target).isNotNull())
    rows = rows if per_class is None else sample_per_group(rows, per_class, (target,), F.col("video_id"))
    return encode_labels(rows.select("video_id", F.col(target).alias("label")), "label")


def augmentation_plan(clips: DataFrame, epoch: int = 0, enlarge: float = 1.15, size: int = 112, jitter: float = 0.2) -> DataFrame:
    """One row per clip: the crop, flip, brightness and contrast that all its frames share in this epoch.

    Frames are enlarged to ``enlarge`` times ``size``, cropped to ``size`` at (top, left),
    flipped for half of the clips, and scaled by 1 - jitter to 1 + jitter. All come
    from digests of clip and epoch, so reruns and other machines agree.
    """
    room = int(size * enlarge) - size

    def unit(name: str) -> Column:
        digest = F.md5(F.concat(F.col("video_id").cast("string"), F.lit(f":{epoch}:{name}")).cast("binary"))
        return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / 4294967296.0

    scale = lambda name: 1 - jitter + 2 * jitter * unit(name)
    return clips.select("video_id", F.floor(unit("top") * (room + 1)).cast("long").alias("top"), F.floor(unit("left") * (room + 1)).cast("long").alias("left"), (unit("flip") < 0.5).alias("flip"), scale("brightness").alias("brightness"), scale("contrast").alias("contrast"))


def run_summary(outcomes: DataFrame) -> DataFrame:
    """One row of a run's counts: videos, successes, failures, and the share of successes in percent."""
    ok = F.count_if(F.col("reason").isNull())
    return outcomes.agg(F.count("*").alias("n_videos"), ok.alias("n_successful"), F.count_if(F.col("reason").isNotNull()).alias("n_failed"), F.countDistinct("activity").alias("n_activities"), F.countDistinct("distortion").alias("n_distortions"), (ok / F.count("*") * 100).alias("success_rate"))


def outcome_stats(outcomes: DataFrame, by: str = "distortion") -> DataFrame:
    """Per group: videos, successes, failures by reason, frames, tracks, mean length, success rate in percent."""
    failed = lambda r: F.count_if(F.col("reason") == r)
    return outcomes.groupBy(by).agg(
        F.count("*").alias("total"), F.count_if(F.col("reason").isNull()).alias("successful"), F.count_if(F.col("reason").isNotNull()).alias("failed"), failed("file_missing").alias("file_missing"), failed("detection_failure").alias("failure_detection"), failed("track_too_short").alias("failure_track_too_short"),
        F.coalesce(F.sum("n_tracks"), F.lit(0)).alias("n_tracks_total"), F.coalesce(F.sum("n_frames"), F.lit(0)).alias("n_frames_total"), ratio(F.coalesce(F.sum("points"), F.lit(0)), F.coalesce(F.sum("n_tracks"), F.lit(0))).alias("mean_track_length"), (F.count_if(F.col("reason").isNull()) / F.count("*") * 100).alias("success_rate"),
    )


def failures_by_class(outcomes: DataFrame, shown: int = 3) -> DataFrame:
    """Per activity: failed videos, and the first few of them by id (bounded by a window, not a list of all)."""
    place = F.row_number().over(Window.partitionBy("activity").orderBy("video_id"))
    bad = outcomes.where("reason is not null").withColumn("place", place)
    return bad.groupBy("activity").agg(F.count("*").alias("n_failed"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("place") <= shown, F.col("video_id")))).cast("array<string>"), ",").alias("shown"))
