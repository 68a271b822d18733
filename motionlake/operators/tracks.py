"""Features of trajectories, of pairs of tracks, and their pooling per video.

Input rows are (video_id, track_id, seq, x, y). All differences along a track share
one window, so a table is shuffled and sorted once; what follows is grouped with
partial aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import distance, ratio, wrapped

TRACK = ["video_id", "track_id"]
TRAJECTORY = [
    "track_duration_sec", "path_speed_px_s", "net_displacement_speed_px_s", "straightness", "mean_speed_px_s", "max_speed_px_s", "std_speed_px_s",
    "skew_speed", "kurt_speed", "mean_direction_deg", "direction_std_deg", "bbox_area", "mean_flow_magnitude", "mean_flow_angle_deg",
]
CIRCULAR = ["circular_mean_rad", "circular_variance", "direction_concentration", "angular_dispersion"]
KINEMATICS = [f"{stat}_{what}" for what in ("accel_px_s2", "jerk_px_s3") for stat in ("mean", "std", "max")] + ["skew_accel", "skew_jerk"]
CURVATURE = ["mean_curvature", "std_curvature", "turning_rate_rad_s", "path_efficiency"]
INTERACTION = ["mean_pairwise_distance", "min_pairwise_distance", "std_pairwise_distance", "mean_relative_speed_px_s", "max_relative_speed_px_s", "proximity_duration_ratio", "proximity_event_rate_s"]
LONG_TRACK, RETENTION = 15, range(5, 101, 5)


def steps(points: DataFrame, fps: float = 10.0) -> DataFrame:
    """Adds speed (px a frame), angle, turn, accel and jerk of each point against those before it."""
    along = Window.partitionBy(*TRACK).orderBy("seq")
    before = lambda c: F.lag(c).over(along)
    moved = points.withColumns({"dx": F.col("x") - before("x"), "dy": F.col("y") - before("y")})
    moved = moved.withColumns({"speed": distance(F.col("dx"), F.col("dy")), "angle": F.atan2("dy", "dx")})
    moved = moved.withColumns({"turn": wrapped(F.col("angle") - before("angle")), "accel": (F.col("speed") - before("speed")) * fps})
    return moved.withColumn("jerk", (F.col("accel") - before("accel")) * fps)


def _net() -> Column:
    last, first = F.max_by(F.struct("x", "y"), "seq"), F.min_by(F.struct("x", "y"), "seq")
    return distance(last["x"] - first["x"], last["y"] - first["y"])


def _shape(name: str, c: Column, enough: Column) -> Column:
    return F.when(enough, getattr(F, name)(c)).otherwise(0.0)


def trajectory_features(points: DataFrame, fps: float = 10.0, flow: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """14 features of each track of two points or more; the skew of constant speed is null."""
    speed, heading = F.col("speed") * fps, F.pmod(F.degrees("angle"), F.lit(360.0))
    some = F.count("speed") > 2
    found = steps(points, fps).groupBy(*TRACK).agg(
        F.count("*").alias("n"), F.sum("speed").alias("path"), _net().alias("net"), F.avg(speed).alias("mean_speed_px_s"), F.max(speed).alias("max_speed_px_s"), F.stddev_pop(speed).alias("std_speed_px_s"),
        _shape("skewness", speed, some).alias("skew_speed"), _shape("kurtosis", speed, some).alias("kurt_speed"), F.avg(heading).alias("mean_direction_deg"), F.stddev_pop(heading).alias("direction_std_deg"),
        ((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("bbox_area"),
    ).where("n >= 2")
    seconds = F.col("n") / fps
    return found.withColumns(
        {"track_duration_sec": seconds, "path_speed_px_s": F.col("path") / seconds, "net_displacement_speed_px_s": F.col("net") / seconds, "straightness": ratio(F.col("net"), F.col("path")), "mean_flow_magnitude": F.lit(flow[0]), "mean_flow_angle_deg": F.lit(flow[1])}
    ).select(*TRACK, *TRAJECTORY)


def circular_features(points: DataFrame) -> DataFrame:
    """Circular mean, variance, concentration and dispersion of headings."""
    angles = steps(points).where("angle is not null").select(*TRACK, "angle")
    over = Window.partitionBy(*TRACK)
    c, s = F.avg(F.cos("angle")).over(over), F.avg(F.sin("angle")).over(over)
    centred = angles.withColumns({"c": c, "s": s}).withColumn("mean", F.atan2("s", "c"))
    off = F.atan2(F.sin(F.col("angle") - F.col("mean")), F.cos(F.col("angle") - F.col("mean")))
    length = F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s"))
    found = centred.withColumns({"r": length, "off": off}).groupBy(*TRACK).agg(F.first("mean").alias("circular_mean_rad"), F.first("r").alias("direction_concentration"), F.stddev_pop("off").alias("angular_dispersion"))
    return found.withColumn("circular_variance", 1 - F.col("direction_concentration")).select(*TRACK, *CIRCULAR)


def kinematics_features(points: DataFrame, fps: float = 10.0) -> DataFrame:
    """Acceleration and jerk of tracks with two jerk values or more."""
    agg = [F.count("jerk").alias("n")]
    for c, unit in (("accel", "accel_px_s2"), ("jerk", "jerk_px_s3")):
        agg += [F.avg(c).alias(f"mean_{unit}"), F.stddev_pop(c).alias(f"std_{unit}"), F.max(F.abs(c)).alias(f"max_{unit}"), _shape("skewness", F.col(c), F.count(c) > 2).alias(f"skew_{c}")]
    return steps(points, fps).groupBy(*TRACK).agg(*agg).where("n >= 2").select(*TRACK, *KINEMATICS)


def curvature_features(points: DataFrame, fps: float = 10.0) -> DataFrame:
    """Turning and path efficiency of tracks of four points or more."""
    found = steps(points, fps).groupBy(*TRACK).agg(F.count("*").alias("n"), F.avg("turn").alias("mean_curvature"), F.stddev_pop("turn").alias("std_curvature"), F.sum("turn").alias("turned"), F.sum("speed").alias("path"), _net().alias("net"))
    return found.where("n >= 4").withColumns({"turning_rate_rad_s": F.col("turned") / (F.col("n") / fps), "path_efficiency": ratio(F.col("net"), F.col("path"))}).select(*TRACK, *CURVATURE)


def dense_features(points: DataFrame, min_points: int = LONG_TRACK) -> DataFrame:
    """Length, displacement, speed and direction (radians) of tracks of ``min_points`` or more."""
    found = steps(points).groupBy(*TRACK).agg(F.count("*").cast("double").alias("dense_traj_length"), _net().alias("dense_traj_displacement"), F.avg("speed").alias("dense_traj_mean_speed"), F.stddev_pop("speed").alias("dense_traj_std_speed"), F.avg("angle").alias("dense_traj_direction_mean"), F.stddev_pop("angle").alias("dense_traj_direction_std"))
    return found.where(F.col("dense_traj_length") >= min_points)


def interaction_features(points: DataFrame, fps: float = 10.0, near: float = 100.0, min_points: int = LONG_TRACK) -> DataFrame:
    """How each track of ``min_points`` or more moves against all others of its video at the same seq.

    One equi-join on (video, seq); what a pair did one step before comes along with
    each point, so runs of nearness need no window over pairs.
    """
    along = Window.partitionBy(*TRACK).orderBy("seq")
    full = steps(points, fps).withColumns({"px": F.lag("x").over(along), "py": F.lag("y").over(along), "n": F.count("*").over(Window.partitionBy(*TRACK))}).select(*TRACK, "seq", "x", "y", "px", "py", "speed", "n").where("n >= 2")
    a, b = full.alias("a").where(F.col("a.n") >= min_points), full.alias("b")
    both = a.join(b, (F.col("a.video_id") == F.col("b.video_id")) & (F.col("a.seq") == F.col("b.seq")) & (F.col("a.track_id") != F.col("b.track_id")))
    d = distance(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y"))
    before = distance(F.col("a.px") - F.col("b.px"), F.col("a.py") - F.col("b.py"))
    rel = F.abs(F.col("a.speed") - F.col("b.speed")) * fps
    seen = both.select(F.col("a.video_id").alias("video_id"), F.col("a.track_id").alias("track_id"), d.alias("d"), rel.alias("rel"), (d < near).alias("is_near"), F.coalesce(before < near, F.lit(False)).alias("was_near"))
    found = seen.groupBy(*TRACK).agg(
        F.avg("d").alias("mean_pairwise_distance"), F.min("d").alias("min_pairwise_distance"), F.stddev_pop("d").alias("std_pairwise_distance"), F.coalesce(F.avg("rel"), F.lit(0.0)).alias("mean_relative_speed_px_s"), F.coalesce(F.max("rel"), F.lit(0.0)).alias("max_relative_speed_px_s"),
        (F.count_if("is_near") / F.count("*")).alias("proximity_duration_ratio"), (F.count_if(F.col("is_near") & ~F.col("was_near")) / (F.count("*") / fps)).alias("proximity_event_rate_s"),
    )
    return found.select(*TRACK, *INTERACTION)


def pool(features: DataFrame, names: list[str]) -> DataFrame:
    """Per video: mean, max and population deviation of each feature over tracks that have it, and their number."""
    any_ = reduce(lambda p, q: p | q, [F.col(n).isNotNull() for n in names])
    agg = [f(n).alias(f"{n}_{s}") for n in names for s, f in (("mean", F.avg), ("max", F.max), ("std", F.stddev_pop))]
    return features.groupBy("video_id").agg(F.count_if(any_).alias("n_valid_tracks"), *agg)


def lengths(points: DataFrame) -> DataFrame:
    """video_id, track_id, len."""
    return points.groupBy(*TRACK).agg(F.count("*").alias("len"))


def temporal_context(points: DataFrame, long: int = LONG_TRACK) -> DataFrame:
    """Eight features of each video's tracks; frames are counted to the last seq."""
    track = points.groupBy(*TRACK).agg(F.count("*").alias("len"), F.max("seq").alias("last"), *(f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("s", F.sum), ("q", lambda v: F.sum(F.col(v) * F.col(v))))))
    n_long = F.count_if(F.col("len") >= long)
    sd = lambda c: F.sqrt(F.greatest(F.sum(f"q{c}") / F.sum("len") - (F.sum(f"s{c}") / F.sum("len")) * (F.sum(f"s{c}") / F.sum("len")), F.lit(0.0)))
    return track.groupBy("video_id").agg(
        F.count("*").cast("double").alias("temporal_n_tracks"), n_long.cast("double").alias("temporal_n_long_tracks"), F.stddev_pop("len").alias("temporal_spread"), ((sd("x") + sd("y")) / 2).alias("temporal_spatial_spread"),
        (n_long * (n_long - 1) / 2).alias("temporal_overlap_count"), (F.sum("len") / (F.max("last") + 1)).alias("temporal_tracks_per_frame"), F.avg("len").alias("temporal_mean_track_len"), F.max("len").cast("double").alias("temporal_max_track_len"),
    )


def missed_frames(points: DataFrame) -> DataFrame:
    """video_id, track_id, len, disappeared and frames: how long ago a track was last seen at its
    video's end, and the video's length, both counted by seq."""
    per = points.groupBy(*TRACK).agg(F.count("*").alias("len"), F.max("seq").alias("last"))
    end = per.groupBy("video_id").agg(F.max("last").alias("end"))
    return per.join(end, "video_id").select(*TRACK, "len", (F.col("end") - F.col("last")).alias("disappeared"), (F.col("end") + 1).alias("frames"))


def tracker_metrics(tracks: DataFrame, by: tuple[str, ...] = ("video_id",), thresholds: tuple[int, ...] = (15, 30, 45, 60, 90)) -> DataFrame:
    """Per video, from rows (video_id, track_id, len, disappeared, frames): numbers, lengths, coverage, continuity."""
    n, frames = F.count("*"), F.max("frames")
    agg = [n.alias("n_tracks"), F.avg("len").alias("mean_track_length"), F.percentile("len", F.lit(0.5)).alias("median_track_length"), F.stddev_pop("len").alias("std_track_length"), F.max("len").alias("max_track_length"), F.min("len").alias("min_track_length")]
    agg += [(F.sum("len") / (n * frames)).alias("track_coverage"), (n / frames).alias("tracks_per_frame")]
    for t in thresholds:
        agg += [F.count_if(F.col("len") >= t).alias(f"tracks_ge_{t}_frames"), (F.count_if(F.col("len") >= t) / n * 100).alias(f"tracks_ge_{t}_pct")]
    gaps = F.count_if(F.col("disappeared") > 0)
    return tracks.groupBy(*by).agg(*agg, gaps.alias("tracks_with_gaps"), (1 - gaps / n).alias("track_continuity"))


def length_percentiles(track_lengths: DataFrame) -> DataFrame:
    """One row: the 10, 25, 50, 75 and 90 % points of all track lengths, interpolated."""
    return track_lengths.agg(*(F.percentile("len", F.lit(p / 100)).alias(f"percentile_{p}") for p in (10, 25, 50, 75, 90)))


def length_retention(track_lengths: DataFrame, thresholds=RETENTION) -> DataFrame:
    """Per threshold: tracks at least so long, their share in percent and mean length; and
    whether it is the first of 30, 45, 60 that retains 80 %.

    Tracks are counted by length first, so only distinct lengths meet the thresholds.
    """
    counted = track_lengths.groupBy("len").agg(F.count("*").alias("n"))
    at = counted.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    kept = F.col("len") >= F.col("threshold")
    out = at.groupBy("threshold").agg(F.sum(F.when(kept, F.col("n")).otherwise(0)).alias("retained_tracks"), (F.sum(F.when(kept, F.col("n")).otherwise(0)) / F.sum("n") * 100).alias("retention_rate"), ratio(F.sum(F.when(kept, F.col("n") * F.col("len")).otherwise(0)), F.sum(F.when(kept, F.col("n")).otherwise(0))).alias("mean_length_retained"))
    good = F.when(F.col("threshold").isin(30, 45, 60) & (F.col("retention_rate") >= 80), F.col("threshold"))
    return out.withColumn("recommended", F.coalesce(F.col("threshold") == F.min(good).over(Window.partitionBy(F.lit(0))), F.lit(False)))


def length_histogram(track_lengths: DataFrame, bins: int = 30) -> DataFrame:
    """bin, n: lengths in equal bins from the least to the greatest; empty bins are left out."""
    counted = track_lengths.groupBy("len").agg(F.count("*").alias("n"))
    ends = counted.agg(F.min("len").alias("low"), F.max("len").alias("high"))
    width = F.greatest((F.col("high") - F.col("low")) / bins, F.lit(1e-12))
    return counted.join(F.broadcast(ends)).withColumn("bin", F.least(F.floor((F.col("len") - F.col("low")) / width), F.lit(bins - 1))).groupBy("bin").agg(F.sum("n").alias("n"))


def track_confidence(track_lengths: DataFrame, min_len: int = LONG_TRACK) -> DataFrame:
    return track_lengths.groupBy("video_id").agg(F.avg(F.least(F.col("len") / min_len, F.lit(1.0))).alias("confidence"))


def cap_trajectory(points: DataFrame, most: int = 300) -> DataFrame:
    """The last ``most`` points of each track."""
    newest = Window.partitionBy(*TRACK).orderBy(F.desc("seq"))
    return points.withColumn("_place", F.row_number().over(newest)).where(F.col("_place") <= most).drop("_place")


def ema_quality(points: DataFrame, alpha: float = 0.8) -> DataFrame:
    """Per track, the recursive quality ``q = alpha q + (1 - alpha) raw`` from q = 1 over raw in 0 to 1.

    Each point's weight depends on how many follow it, so it is a sum, not a loop.
    """
    left = F.row_number().over(Window.partitionBy(*TRACK).orderBy(F.desc("seq"))) - 1
    weighted = points.withColumn("w", F.pow(F.lit(alpha), left))
    return weighted.groupBy(*TRACK).agg((F.pow(F.lit(alpha), F.count("*")) + (1 - alpha) * F.sum(F.col("w") * F.col("raw"))).alias("quality"))
