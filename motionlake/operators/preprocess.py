"""Frame preprocessing, optical flow and appearance, as maps over frames in Arrow batches.

Rows are (video_id, frame_no, height, width, pixels binary).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import images
from ..functions.kernels import block_flow
from .tracking import scaled

FRAME = "video_id long, frame_no long, height int, width int, pixels binary"
DIAGNOSTICS = "blur_score double, brightness double, laplacian_var double, tenengrad double, brenner double, distortion_type string, enhanced boolean"
KINDS = ("passthrough", "standard", "distortion_aware")


def classify(blur: float, brightness: float, least: float = 100.0, dark: float = 60.0, bright: float = 195.0) -> str:
    exposed = "underexposed" if brightness < dark else "overexposed" if brightness > bright else None
    if blur < least:
        return "blurry+exposure" if exposed else "blurry"
    return exposed or "pristine"


def enhance(gray: np.ndarray, kind: str, for_blur: str = "unsharp_mask", for_exposure: str = "clahe", correct_gamma: bool = True, stretch: bool = True) -> tuple[np.ndarray, bool]:
    """The frame after the steps that its distortion calls for, and whether there were any."""
    exposed, blurry = kind in ("underexposed", "overexposed", "blurry+exposure"), kind.startswith("blurry")
    if exposed and correct_gamma:
        gray = images.gamma(gray)
    if blurry:
        gray = {"unsharp_mask": images.unsharp, "wiener": images.wiener}.get(for_blur, lambda g: g)(gray)
    if exposed:
        gray = {"clahe": images.equalised, "bilateral": images.bilateral}.get(for_exposure, lambda g: g)(gray)
        if stretch:
            gray = images.stretched(gray)
    return gray, exposed or blurry


def preprocess(frames: DataFrame, kind: str = "distortion_aware", height: int = 480, width: int = 640, **how) -> DataFrame:
    """Frames after preprocessing, with diagnostics; frames whose bytes don't fit their size are left out.

    ``standard`` blurs and then measures; ``distortion_aware`` measures, enhances by
    distortion, then blurs, and its blur_score is ``1 - min(laplacian_var / 500, 1)``.
    """
    if kind not in KINDS:
        raise ValueError(f"{kind} is none of {KINDS}")

    def one(gray: np.ndarray) -> tuple:
        if kind == "passthrough":
            return gray, None, None, None, None, None, None, False
        gray = images.resized(gray, height, width)
        if kind == "standard":
            gray = images.to_bytes(images.gaussian(gray))
            return gray, images.laplacian_variance(gray), float(gray.mean()), None, None, None, None, False
        lap, mean = images.laplacian_variance(gray), float(gray.mean())
        gx, gy = images.gradients(gray)
        brenner = float(np.abs(np.diff(gray.astype(float), axis=1)).mean()) if gray.shape[1] > 1 else 0.0
        label = classify(lap, mean)
        better, changed = enhance(gray, label, **how)
        return images.to_bytes(images.gaussian(better)), 1 - min(lap / 500, 1.0), mean, lap, float(np.hypot(gx, gy).mean()), brenner, label, changed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for v, no, h, w, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if raw is not None and h and w and len(raw) == h * w:
                    gray, *rest = one(np.frombuffer(raw, np.uint8).reshape(h, w))
                    rows.append((v, no, *gray.shape, gray.tobytes(), *rest))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), *[pa.float64()] * 5, pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [c.split()[0] for c in f"{FRAME}, {DIAGNOSTICS}".split(", ")])

    return frames.selectExpr("cast(video_id as long) video_id", "cast(frame_no as long) frame_no", "cast(height as int) height", "cast(width as int) width", "pixels").mapInArrow(run, f"{FRAME}, {DIAGNOSTICS}")


def flow_vectors(frames: DataFrame, block: int = 8, reach: int = 4) -> DataFrame:
    """video_id, frame_no, x, y, dx, dy: motion of each block against the frame before, by block matching."""
    before = F.lag(F.struct("height", "width", "pixels")).over(Window.partitionBy("video_id").orderBy("frame_no"))
    pairs = frames.withColumn("before", before).where("before.height = height and before.width = width").selectExpr("cast(video_id as long)", "cast(frame_no as long)", "cast(height as int)", "cast(width as int)", "pixels", "before.pixels AS earlier")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = [], []
            for v, no, h, w, now, old in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if h >= block and w >= block:
                    moved = block_flow(np.frombuffer(old, np.uint8).reshape(h, w), np.frombuffer(now, np.uint8).reshape(h, w), block, reach)
                    found.append(moved.astype(float))
                    keys += [(v, no)] * len(moved)
            xy = np.concatenate([*found, np.zeros((0, 4))])
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)] + [pa.array(xy[:, i]) for i in range(4)], ["video_id", "frame_no", "x", "y", "dx", "dy"])

    return pairs.mapInArrow(run, "video_id long, frame_no long, x double, y double, dx double, dy double")


def mean_flow(vectors: DataFrame) -> DataFrame:
    """Per video: mean magnitude, and arithmetic mean of directions in degrees, of frames' mean flow."""
    size = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    per = vectors.groupBy("video_id", "frame_no").agg(F.avg(size).alias("m"), F.avg(F.pmod(F.degrees(F.atan2("dy", "dx")), F.lit(360.0))).alias("a"))
    return per.groupBy("video_id").agg(F.avg("m").alias("mean_flow_magnitude"), F.avg("a").alias("mean_flow_angle_deg"))


def appearance(frames: DataFrame, detections: DataFrame, scales: Sequence[float] = (1.0,)) -> DataFrame:
    """Detections with ``look``: nine gradient directions of each box's part of its frame for each
    of ``scales``, by which the box is scaled about its centre; zeros without a frame."""
    joined = detections.join(frames.select("video_id", "frame_no", "height", "width", "pixels"), ["video_id", "frame_no"], "left")
    cols = ["video_id", "frame_no", "det_id", "x", "y", "w", "h"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            looks = []
            given = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3, 7)], axis=1).astype(float)
            at = [scaled(given, np.full(len(given), s)).astype(int) for s in scales]
            for i, (fh, fw, raw) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(7, 10)), strict=True)):
                look = np.zeros((len(scales), 9))
                if raw is not None and len(raw) == fh * fw:
                    frame = np.frombuffer(raw, np.uint8).reshape(fh, fw)
                    for k, boxes in enumerate(at):
                        x, y, w, h = boxes[i].tolist()
                        x, y = max(0, x), max(0, y)
                        part = frame[y : y + max(1, h), x : x + max(1, w)]
                        look[k] = images.orientation9(images.resized(part, 64, 64)) if part.size else 0.0
                looks.append(look.ravel().tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(looks, pa.list_(pa.float64()))], [*cols, "look"])

    ready = joined.select(*(F.col(c).cast("long").alias(c) for c in cols), F.col("height").cast("int"), F.col("width").cast("int"), "pixels").na.drop(subset=cols)
    return ready.mapInArrow(run, ", ".join(f"{c} long" for c in cols) + ", look array<double>")


def frame_keypoints(gray: np.ndarray, step: int = 5, texture: float = 10.0, most: tuple[int, int] = (100, 50)) -> list[tuple[int, int, str]]:
    """x, y, source of a frame's keypoints: strong corners, then ring corners, then grid points
    whose 5 x 5 surroundings vary by more than ``texture``; of each cell of ``step`` pixels the first."""
    h, w = gray.shape
    found = [(x, y, "corner") for x, y in images.strong_corners(gray, most[0], apart=step)]
    found += [(x, y, "ring") for x, y in images.ring_corners(gray)[: most[1]]]
    box, f = np.full(5, 0.2), gray.astype(float)
    sd = np.sqrt(np.maximum(images.spread(f * f, box) - images.spread(f, box) ** 2, 0))
    ys, xs = np.meshgrid(range(step, h - step, step), range(step, w - step, step), indexing="ij")
    rough = sd[ys, xs] > texture
    found += [(x, y, "grid") for x, y in zip(xs[rough].tolist(), ys[rough].tolist(), strict=True)]
    first: dict[tuple[int, int], tuple[int, int, str]] = {}
    for x, y, source in found:
        first.setdefault((x // step, y // step), (x, y, source))
    return list(first.values())


def keypoints(frames: DataFrame, step: int = 5, texture: float = 10.0) -> DataFrame:
    """video_id, frame_no, place (from 0, in order of choice), x, y, source of each frame's keypoints;
    frames whose bytes don't fit their size, and those smaller than two steps, have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for v, no, h, w, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if raw is not None and h and w and len(raw) == h * w and min(h, w) > 2 * step:
                    rows += [(v, no, i, *p) for i, p in enumerate(frame_keypoints(np.frombuffer(raw, np.uint8).reshape(h, w), step, texture))]
            kinds = [pa.int64()] * 5 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["video_id", "frame_no", "place", "x", "y", "source"])

    return frames.selectExpr("cast(video_id as long)", "cast(frame_no as long)", "cast(height as int)", "cast(width as int)", "pixels").mapInArrow(run, "video_id long, frame_no long, place long, x long, y long, source string")


HISTOGRAMS = [f"dense_{kind}_bin_{i}" for kind in ("hog", "hof", "mbhx", "mbhy") for i in range(9)]
SCENE = ["dense_keypoint_density", "dense_flow_magnitude_mean", "dense_flow_magnitude_std", "dense_texture_variance", "dense_edge_density"]


def local_descriptor(gray: np.ndarray, flow: np.ndarray) -> np.ndarray:
    """36 shares around a keypoint: gradient directions, directions of flow over a pixel, and
    changes of the flow's parts across and down in -10 to 10, nine bins each."""
    gx, gy = images.gradients(gray)
    size = np.hypot(flow[..., 0], flow[..., 1])
    angle = np.arctan2(flow[..., 1], flow[..., 0]) % (2 * np.pi)
    share = lambda n: n / (n.sum() + 1e-7)
    bins = lambda v, low, high, **how: np.histogram(v, bins=9, range=(low, high), **how)[0].astype(float)
    grads = bins(np.arctan2(gy, gx) % np.pi, 0, np.pi, weights=np.hypot(gx, gy))
    across, down = images.gradients(flow[..., 0])[0], images.gradients(flow[..., 1])[1]
    return np.concatenate([share(grads), share(bins(angle[size > 1], 0, 2 * np.pi)), share(bins(across, -10, 10)), share(bins(down, -10, 10))])


def dense_descriptors(frames: DataFrame, step: int = 5, block: int = 32, most: int = 20) -> DataFrame:
    """Per frame with an earlier one of its size: the mean local descriptor of its first ``most`` keypoints
    and five numbers of the scene; 0 where a frame has no keypoint.

    Flow is that of ``block_flow``, spread over its blocks.
    """
    before = F.lag(F.struct("height", "width", "pixels")).over(Window.partitionBy("video_id").orderBy("frame_no"))
    pairs = frames.withColumn("before", before).where("before.height = height and before.width = width and length(pixels) = height * width and length(before.pixels) = height * width")
    pairs = pairs.selectExpr("cast(video_id as long)", "cast(frame_no as long)", "cast(height as int)", "cast(width as int)", "pixels", "before.pixels AS earlier")

    def one(gray: np.ndarray, earlier: np.ndarray) -> list[float]:
        h, w = gray.shape
        flow = np.zeros((h, w, 2))
        if min(h, w) >= 8:
            for x, y, dx, dy in block_flow(earlier, gray).tolist():
                flow[y - 4 : y + 4, x - 4 : x + 4] = dx, dy
        points = frame_keypoints(gray, step) if min(h, w) > 2 * step else []
        half, found = block // 2, []
        for x, y, _ in points[:most]:
            part = slice(max(0, y - half), y + half), slice(max(0, x - half), x + half)
            found.append(local_descriptor(gray[part], flow[part]))
        size, edges = np.hypot(flow[..., 0], flow[..., 1]), np.hypot(*images.gradients(gray))
        scene = [float(len(points)), size.mean(), size.std(), gray.astype(float).var(), (edges > 100).mean()]
        return [*(np.mean(found, axis=0) if found else np.zeros(36)), *scene]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, w, now, old in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                rows.append(one(np.frombuffer(now, np.uint8).reshape(h, w), np.frombuffer(old, np.uint8).reshape(h, w)))
            values = np.array(rows, float).reshape(-1, 41)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(values[:, i].copy()) for i in range(41))], ["video_id", "frame_no", *HISTOGRAMS, *SCENE])

    return pairs.mapInArrow(run, ", ".join(["video_id long, frame_no long", *(f"{c} double" for c in HISTOGRAMS + SCENE)]))
