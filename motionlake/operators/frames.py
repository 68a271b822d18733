"""Operators on gray frames that are array columns, row by row.

Everything within one frame is an array expression, so frames are never shuffled;
only differences between frames use a window over each video. Borders are reflected
without repeating the edge, but for texture codes, which wrap around.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio

SOBEL_X = ((-1, -1, -1), (-1, 1, 1), (0, -1, -2), (0, 1, 2), (1, -1, -1), (1, 1, 1))
SOBEL_Y = ((-1, -1, -1), (-1, 0, -2), (-1, 1, -1), (1, -1, 1), (1, 0, 2), (1, 1, 1))
AROUND = ((-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1))


def _reflect(i: Column, n: int) -> Column:
    return F.when(i < 0, -i).when(i >= n, 2 * n - 2 - i).otherwise(i)


def _at(px: Column, i: Column, dr: int, dc: int, width: int, height: int, wrap: bool = False) -> Column:
    r, c = F.floor(i / width) + dr, i % width + dc
    r, c = (F.pmod(r, F.lit(height)), F.pmod(c, F.lit(width))) if wrap else (_reflect(r, height), _reflect(c, width))
    return F.get(px, (r * width + c).cast("int"))


def _map(px: Column, width: int, height: int, f) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), f)


def filtered(px: Column, taps, width: int, height: int) -> Column:
    """Each pixel's sum over taps (row offset, column offset, weight)."""
    return _map(px, width, height, lambda i: sum((_at(px, i, dr, dc, width, height) * k for dr, dc, k in taps), F.lit(0)))


def mean_of(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)


def var_of(a: Column) -> Column:
    m = mean_of(a)
    return mean_of(F.transform(a, lambda v: v.cast("double") * v)) - m * m


def quality(frames: DataFrame, width: int = 8, height: int = 8) -> DataFrame:
    """frame_no, brightness, laplacian_var, tenengrad, brenner."""
    px = F.col("pixels")
    laplace = filtered(px, ((-1, 0, 1), (1, 0, 1), (0, -1, 1), (0, 1, 1), (0, 0, -4)), width, height)
    ready = frames.withColumns({"lap": laplace, "gx": filtered(px, SOBEL_X, width, height), "gy": filtered(px, SOBEL_Y, width, height)})
    across = F.filter(_map(px, width, height, lambda i: F.when(i % width > 0, F.abs(F.get(px, i) - F.get(px, i - 1)))), lambda v: v.isNotNull())
    edge = F.zip_with("gx", "gy", lambda a, b: F.sqrt((a * a + b * b).cast("double")))
    return ready.select("frame_no", mean_of(px).alias("brightness"), var_of(F.col("lap")).alias("laplacian_var"), mean_of(edge).alias("tenengrad"), mean_of(across).alias("brenner"))


def distortion_label(frame_quality: DataFrame, blur: float = 100.0, dark: float = 60.0, bright: float = 195.0) -> DataFrame:
    """Adds is_blurry, is_underexposed, is_overexposed and the five-way distortion_type."""
    q = frame_quality.withColumns({"is_blurry": F.col("laplacian_var") < blur, "is_underexposed": F.col("brightness") < dark, "is_overexposed": F.col("brightness") > bright})
    exposed = F.col("is_underexposed") | F.col("is_overexposed")
    kind = F.when(F.col("is_blurry") & exposed, "blurry+exposure").when(F.col("is_blurry"), "blurry").when(F.col("is_underexposed"), "underexposed").when(F.col("is_overexposed"), "overexposed").otherwise("pristine")
    return q.withColumns({"distortion_type": kind, "blur_score": 1 - F.least(F.col("laplacian_var") / 500, F.lit(1.0))})


def pool_quality(frame_quality: DataFrame, video: Column, low_contrast: float = 50.0) -> DataFrame:
    """16 pooled features per video."""
    agg = []
    for name, c in (("laplacian", "laplacian_var"), ("tenengrad", "tenengrad"), ("brenner", "brenner")):
        agg += [f(c).alias(f"diag_{name}_{s}") for s, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    agg += [F.avg("brightness").alias("diag_brightness_mean"), F.var_pop("brightness").alias("diag_brightness_var"), (F.max("brightness") - F.min("brightness")).alias("diag_dynamic_range"), (F.count_if(F.col("laplacian_var") < low_contrast) / F.count("*")).alias("diag_low_contrast_ratio")]
    return frame_quality.groupBy(video.alias("video_id")).agg(*agg)


def texture(frames: DataFrame, width: int = 8, height: int = 8) -> DataFrame:
    """frame_no, bin, share: histogram of uniform local binary patterns (bin 9: not uniform)."""
    px = F.col("pixels")
    bit = lambda i, b: F.when(F.get(px, i) >= _at(px, i, -AROUND[b][0], -AROUND[b][1], width, height, True), 1 << b).otherwise(0)
    code = _map(px, width, height, lambda i: sum((bit(i, b) for b in range(8)), F.lit(0)))
    turned = lambda v: v.bitwiseXOR(F.shiftright(v, 1).bitwiseOR(F.shiftleft(v.bitwiseAND(F.lit(1)), 7)))
    bins = F.transform(code, lambda v: F.when(F.bit_count(turned(v)) <= 2, F.bit_count(v)).otherwise(9))
    return _shares(frames.select("frame_no", bins.alias("bins")), 10, lambda b: F.size(F.filter("bins", lambda v: v == b)).cast("double"))


def _shares(frames: DataFrame, n: int, height_of) -> DataFrame:
    """frame_no, bin, share of n bins, from a column expression for the height of bin b."""
    hist = frames.select("frame_no", F.array(*(height_of(F.lit(b)) for b in range(n))).alias("h"))
    total = F.aggregate("h", F.lit(0.0), lambda s, v: s + v) + 1e-7
    return hist.select("frame_no", F.posexplode(F.transform("h", lambda v: v / total)).alias("bin", "share"))


def orientation(frames: DataFrame, bins: int = 6, width: int = 8, height: int = 8) -> DataFrame:
    """frame_no, bin, share: gradient orientations in 0 to pi, weighted by magnitude."""
    g = frames.withColumns({"gx": filtered(F.col("pixels"), SOBEL_X, width, height), "gy": filtered(F.col("pixels"), SOBEL_Y, width, height)})
    of = lambda a, b: F.struct(F.least(F.floor(F.atan2(F.abs(b), F.abs(a)) / (math.pi / bins)), F.lit(bins - 1)).alias("bin"), F.sqrt((a * a + b * b).cast("double")).alias("mag"))
    ready = g.select("frame_no", F.zip_with("gx", "gy", of).alias("g"))
    return _shares(ready, bins, lambda b: F.aggregate("g", F.lit(0.0), lambda s, v: s + F.when(v["bin"] == b, v["mag"]).otherwise(0.0)))


def pool_bins(shares: DataFrame, video: Column) -> DataFrame:
    """video_id, bin: mean and population deviation of shares over a video's frames."""
    return shares.groupBy(video.alias("video_id"), "bin").agg(F.avg("share").alias("mean"), F.stddev_pop("share").alias("std"))


def percentile_of(a: Column, p: float, n: int) -> Column:
    """Interpolated percentile of an array of n numbers."""
    at = p * (n - 1)
    low, s = int(at), F.sort_array(a)
    return F.get(s, F.lit(low)) + (F.get(s, F.lit(min(low + 1, n - 1))) - F.get(s, F.lit(low))) * (at - low)


def frame_difference(frames: DataFrame, video: Column, least: int = 25, n: int = 64) -> DataFrame:
    """Per frame but a video's first: mean change against the frame before, the threshold
    ``max(least, int(1.5 p75))`` and the number of pixels that change by more."""
    along = Window.partitionBy("video_id").orderBy("frame_no")
    both = frames.withColumn("video_id", video).withColumn("before", F.lag("pixels").over(along)).where("before is not null")
    diff = both.withColumn("d", F.zip_with("pixels", "before", lambda a, b: F.abs(a - b)))
    cut = F.greatest(F.lit(least), F.floor(percentile_of(F.col("d"), 0.75, n) * 1.5))
    return diff.withColumn("threshold", cut).select("video_id", "frame_no", mean_of(F.col("d")).alias("mean_change"), F.col("threshold").cast("long").alias("threshold"), F.size(F.filter("d", lambda v: v > F.col("threshold"))).cast("long").alias("moving"))


def rolling_threshold(signal: DataFrame, value: str, least: float = 2.0, history: int = 20, enough: int = 5, spread: float = 0.5) -> DataFrame:
    """Adds adaptive: mean + spread * deviation of up to ``history`` earlier values, at least
    ``least``, and ``least`` alone until there are ``enough``."""
    before = Window.partitionBy("video_id").orderBy("frame_no").rowsBetween(-history, -1)
    level = F.greatest(F.lit(least), F.avg(value).over(before) + spread * F.stddev_pop(value).over(before))
    return signal.withColumn("adaptive", F.when(F.count(value).over(before) >= enough, level).otherwise(F.lit(least)))


def mask_score(blobs: DataFrame, frame_area: float, low: float = 0.0005, high: float = 0.25, most: float = 30.0, size: float = 0.002) -> DataFrame:
    """Adds score in 0 to 1 to rows with coverage, n_blobs and median_area."""
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    covered = clip(1 - F.abs(F.col("coverage") - 0.02) / 0.23)
    score = clip(covered * clip(1 - F.col("n_blobs") / most) * F.tanh(F.col("median_area") / frame_area / size))
    return blobs.withColumn("score", F.when((F.col("coverage") < low) | (F.col("coverage") > high) | (F.col("n_blobs") == 0), 0.0).otherwise(score))


def relaxed_threshold(quality_: Column, enough: float, usual: float, relaxed: float, floor: float) -> Column:
    """The variance threshold for a frame of that quality: lower the worse it is."""
    lowered = usual - (usual - relaxed) * (1 - quality_ / enough)
    return F.when(quality_ >= enough, F.lit(usual)).otherwise(F.least(F.greatest(lowered, F.lit(floor)), F.lit(usual)))


def flow_pool(vectors: DataFrame, bins: int = 8, moving: float = 1.0) -> DataFrame:
    """Per video, from flow vectors (video_id, frame_no, dx, dy): mean, deviation and maximum of the
    mean magnitude, share moving, direction entropy, and mean change of magnitude."""
    mag = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    angle = F.pmod(F.atan2("dy", "dx"), F.lit(2 * math.pi))
    v = vectors.withColumns({"mag": mag, "bin": F.least(F.floor(angle / (2 * math.pi / bins)), F.lit(bins - 1))})
    counts = [F.count_if((F.col("bin") == b) & (F.col("mag") > moving)).alias(f"h{b}") for b in range(bins)]
    per = v.groupBy("video_id", "frame_no").agg(F.avg("mag").alias("mag"), (F.count_if(F.col("mag") > moving) / F.count("*")).alias("moving"), *counts)
    total = sum((F.col(f"h{b}") for b in range(bins)), F.lit(0)) + 1e-7
    per = per.withColumns({f"h{b}": F.col(f"h{b}") / total for b in range(bins)}).withColumn("jerk", F.abs(F.col("mag") - F.lag("mag").over(Window.partitionBy("video_id").orderBy("frame_no"))))
    out = per.groupBy("video_id").agg(F.avg("mag").alias("flow_mean_mag"), F.stddev_pop("mag").alias("flow_std_mag"), F.max("mag").alias("flow_max_mag"), F.avg("moving").alias("flow_prop_moving"), F.coalesce(F.avg("jerk"), F.lit(0.0)).alias("flow_jerk"), *(f(f"h{b}").alias(f"flow_hof_{s}_{b}") for b in range(bins) for s, f in (("mean", F.avg), ("std", F.stddev_pop))))
    mass = sum((F.col(f"flow_hof_mean_{b}") for b in range(bins)), F.lit(0.0)) + 1e-7
    entropy = -sum((F.when(F.col(f"flow_hof_mean_{b}") > 0, F.col(f"flow_hof_mean_{b}") / mass * F.ln(F.col(f"flow_hof_mean_{b}") / mass + 1e-12)).otherwise(0.0) for b in range(bins)), F.lit(0.0))
    return out.withColumn("flow_dir_entropy", entropy)


def brightness_share(frames: DataFrame) -> DataFrame:
    """frame_no and share of pixels over the frame's own mean."""
    m = mean_of(F.col("pixels"))
    ready = frames.withColumn("m", m)
    return ready.select("frame_no", ratio(F.size(F.filter("pixels", lambda v: v > F.col("m"))).cast("double"), F.size("pixels").cast("double")).alias("share"))
