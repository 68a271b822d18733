"""Detectors over ordered gray frames of each video: background model, frame change, block flow, cascade.

Rows are (video_id, frame_no, height, width, pixels binary). Tasks step through the
frames of a video in order with one small state, as the trackers do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.images import laplacian_variance
from ..functions.kernels import block_flow, boxes, cleaned, dilated, eroded
from .tracking import MAX_POINTS, TRACKERS

OUT = "video_id long, frame_no long, det_id long, x int, y int, w int, h int, area int, detector string"


class FrameDiff:
    """Change against the frame before beyond ``max(least, int(1.5 p75))``; nothing on the first frame."""

    name = "frame_diff"

    def __init__(self, least: int = 25, noise: float = 75.0):
        self.least, self.noise, self.before = least, noise, None

    def mask(self, frame: np.ndarray) -> np.ndarray:
        before, self.before = self.before, frame
        if before is None or before.shape != frame.shape:
            return np.zeros(frame.shape, bool)
        d = np.abs(frame.astype(np.int16) - before)
        return cleaned(d > max(self.least, int(1.5 * np.percentile(d, self.noise))))


def foreground(raw: np.ndarray, shadow_weight: float = 0.0, close: int = 2, open_: int = 1) -> np.ndarray:
    """The cleaned mask of a raw one (255 foreground, 127 shadow): shadows count not at all at
    weight 0, fully at 1, and between only where closing the sure foreground covers them."""
    sure, shadow = raw == 255, raw == 127
    if shadow_weight >= 1:
        sure = sure | shadow
    elif shadow_weight > 0:
        sure = sure | (shadow & eroded(dilated(sure)))
    return cleaned(sure, close, open_)


class Background:
    """A mixture of up to five Gaussians per pixel, learned recursively.

    A pixel is background if it is within ``threshold`` variances of one of the heaviest
    modes that make up nine tenths of the weight; foreground that is a darker shade of
    such a mode, by half at most, is shadow. A mode within nine variances learns the pixel,
    else a new one replaces the lightest; modes that the data don't support fade. Over
    dark or blurred frames the threshold is lower.
    """

    name = "mog2"
    #: Fixed values of the method: modes, share of background, variances, fading, darkest shadow.
    MODES, SHARE, NEAR, FIRST, LEAST, MOST, FADE, DARKEST = 5, 0.9, 9.0, 15.0, 4.0, 75.0, 0.05, 0.5

    def __init__(self, history: int = 20, threshold: float = 16.0, adaptive: bool = True, relaxed: float = 10.0, shadows: bool = True, shadow_weight: float = 0.0):
        self.history, self.threshold, self.adaptive, self.relaxed, self.shadows, self.shadow_weight = history, threshold, adaptive, relaxed, shadows, shadow_weight
        self.weight, self.mean, self.var, self.count = None, None, None, 0

    def _fits(self, v: np.ndarray) -> bool:
        return self.weight is not None and self.weight.shape[1:] == v.shape

    def _faded(self) -> tuple[float, np.ndarray]:
        rate = 1 / min(2 * (self.count + 1), self.history)
        return rate, np.where(self.weight > 0, (1 - rate) * self.weight - rate * self.FADE, 0.0)

    def classified(self, v: np.ndarray, threshold: float) -> np.ndarray:
        """The raw mask of a frame by the model as it is; all foreground without one."""
        if not self._fits(v):
            return np.full(v.shape, 255, np.uint8)
        weight = self._faded()[1]
        alive, d2 = self.weight > 0, (v - self.mean) ** 2
        heavy = alive & (np.cumsum(weight, axis=0) - weight < self.SHARE)
        learns = alive & (d2 < self.NEAR * self.var)
        until = np.where(learns.any(0), learns.argmax(0), self.MODES)  # later modes aren't asked
        background = (heavy & (d2 < threshold * self.var) & (np.arange(self.MODES)[:, None, None] <= until)).any(0)
        raw = np.where(background, 0, 255).astype(np.uint8)
        if self.shadows:
            shade = np.divide(v, self.mean, out=np.full(self.mean.shape, 2.0), where=self.mean > 0)
            raw[~background & (heavy & (shade <= 1) & (shade >= self.DARKEST)).any(0)] = 127
        return raw

    def learn(self, v: np.ndarray) -> None:
        if not self._fits(v):
            self.weight, self.mean, self.var = np.zeros((self.MODES, *v.shape)), np.zeros((self.MODES, *v.shape)), np.full((self.MODES, *v.shape), self.FIRST)
            self.count = 0
        rate, weight = self._faded()
        d2 = (v - self.mean) ** 2
        learns = (self.weight > 0) & (d2 < self.NEAR * self.var)
        own, any_ = learns & (np.cumsum(learns, axis=0) == 1), learns.any(0)  # the heaviest mode that is near
        weight = np.where(own, weight + rate, weight)
        step = np.divide(rate, weight, out=np.zeros_like(weight), where=own)
        self.var = np.where(own, np.clip(self.var + step * (d2 - self.var), self.LEAST, self.MOST), self.var)
        self.mean = self.mean + np.where(own, step * (v - self.mean), 0.0)
        weight = np.where(weight < rate * self.FADE, 0.0, weight)
        # A pixel near no mode takes the place of the lightest one.
        fresh = np.zeros_like(own)
        fresh[-1] = ~any_
        total = np.where(fresh, 0.0, weight).sum(0)
        weight = np.where(fresh, np.where(total > 0, rate, 1.0), weight * np.where(any_, 1.0, 1 - rate))
        self.mean, self.var = np.where(fresh, v, self.mean), np.where(fresh, self.FIRST, self.var)
        weight = weight / weight.sum(0)
        order = np.argsort(-weight, axis=0, kind="stable")
        self.weight, self.mean, self.var = (np.take_along_axis(x, order, 0) for x in (weight, self.mean, self.var))
        self.count += 1

    def mask(self, frame: np.ndarray) -> np.ndarray:
        v = frame.astype(float)
        poor = self.adaptive and (v.mean() < 60 or laplacian_variance(frame) < 100)
        raw = self.classified(v, self.relaxed if poor else self.threshold)
        self.learn(v)
        return foreground(raw, self.shadow_weight)


class Flow:
    """Blocks that move by more than ``max(least, mean + 0.5 sd)`` of the last 20 frames' motion."""

    name = "dense_flow"

    def __init__(self, least: float = 2.0, history: int = 20):
        self.least, self.history, self.before, self.seen = least, history, None, []

    def mask(self, frame: np.ndarray) -> np.ndarray:
        before, self.before = self.before, frame
        out = np.zeros(frame.shape, bool)
        if before is None or before.shape != frame.shape or min(frame.shape) < 8:
            return out
        moved = block_flow(before, frame)
        size = np.hypot(moved[:, 2], moved[:, 3])
        last = self.seen[-self.history :]
        cut = max(self.least, np.mean(last) + 0.5 * np.std(last)) if len(last) >= 5 else self.least
        self.seen = [*last, float(size.mean())]
        for x, y in moved[size > cut, :2]:
            out[y - 4 : y + 4, x - 4 : x + 4] = True
        return out


class Cascade:
    """Background model first; if it finds too little in the warm-up, flow; then frame change."""

    name = "cascaded_fallback"

    def __init__(self, warmup: int = 10, enough: int = 3):
        self.warmup, self.enough, self.count, self.found, self.active = warmup, enough, 0, 0, "mog2"
        self.detectors = {"mog2": Background(), "dense_flow": Flow(), "frame_diff": FrameDiff()}
        self.switches: list[tuple[int, str, str]] = []

    def settle(self, n: int) -> None:
        """Count n detections of the active detector on this frame and switch if due."""
        order = ["mog2", "dense_flow", "frame_diff"]
        self.found += n
        place = order.index(self.active)
        if place < 2 and self.count == self.warmup * (place + 1):
            if self.found < self.enough:
                self.active = order[place + 1]
                self.switches.append((self.count, order[place], self.active))
                self.found = 0


class Adaptive(Background):
    """The mixture model, tried again with a lower threshold on frames whose mask is poor.

    A mask's quality is that of its coverage, number and size of regions; it is mixed
    with a prior on how well tracking goes, which ``feedback`` moves. The second mask
    is taken only if it is strictly better; the model learns each frame once.
    """

    name = "adaptive_mog2"

    def __init__(self, history: int = 20, threshold: float = 16.0, relaxed: float = 10.0, floor: float = 8.0, enough: float = 0.4, mask_weight: float = 0.7, ema: float = 0.8, least_area: int = 500):
        super().__init__(history, threshold, adaptive=False, relaxed=relaxed)
        self.floor, self.enough, self.mask_weight, self.ema, self.least_area = floor, enough, mask_weight, ema, least_area
        self.prior, self.sums = 1.0, dict.fromkeys(("frames", "mask_quality", "track_quality", "threshold", "triggered", "accepted"), 0.0)

    def feedback(self, lengths: list[int], matched: int, min_len: int = 5) -> None:
        """Move the prior by a frame's tracks: their points and how many were matched."""
        raw = min(float(np.mean(lengths)) / min_len, 1.0) * matched / len(lengths) if lengths else 0.0
        self.prior = self.ema * self.prior + (1 - self.ema) * raw

    def quality(self, mask: np.ndarray) -> float:
        covered = float(mask.mean())
        areas = [b[4] for b in boxes(mask) if b[4] >= self.least_area]
        if not 0.0005 <= covered <= 0.25 or not areas:
            return 0.0
        clip = lambda v: min(max(v, 0.0), 1.0)
        return clip(clip(1 - abs(covered - 0.02) / 0.23) * clip(1 - len(areas) / 30) * float(np.tanh(np.median(areas) / mask.size / 0.002)))

    def mask(self, frame: np.ndarray) -> np.ndarray:
        v = frame.astype(float)
        out = foreground(self.classified(v, self.threshold), self.shadow_weight)
        used, quality = self.threshold, self.quality(out)
        combined = self.mask_weight * quality + (1 - self.mask_weight) * self.prior
        if combined < self.enough:
            lowered = min(max(self.threshold - (self.threshold - self.relaxed) * (1 - combined / self.enough), self.floor), self.threshold)
            again = foreground(self.classified(v, lowered), self.shadow_weight)
            self.sums["triggered"] += 1
            if self.quality(again) > quality:
                out, used = again, lowered
                self.sums["accepted"] += 1
        self.learn(v)
        for k, x in (("frames", 1), ("mask_quality", quality), ("track_quality", self.prior), ("threshold", used)):
            self.sums[k] += x
        return out

    def diagnostics(self) -> dict[str, float]:
        """Means over frames, the share of frames tried again, and of those the share accepted."""
        n, t = max(self.sums["frames"], 1), max(self.sums["triggered"], 1)
        return {"avg_mask_quality": self.sums["mask_quality"] / n, "avg_track_quality": self.sums["track_quality"] / n, "avg_threshold_used": self.sums["threshold"] / n, "adaptive_trigger_rate": self.sums["triggered"] / n, "rerun_accept_rate": self.sums["accepted"] / t, "n_frames": self.sums["frames"]}


DETECTORS = {d.name: d for d in (FrameDiff, Background, Adaptive, Flow)}


def stepped(state, frame: np.ndarray, least_area: int) -> tuple[str, list[tuple[int, int, int, int, int]]]:
    """Detector that was active and its boxes of at least that many pixels."""
    if isinstance(state, Cascade):
        state.count += 1
        active = state.active
        masks = {"mog2": state.detectors["mog2"].mask(frame)}  # its model always stays warm
        if active != "mog2":
            masks[active] = state.detectors[active].mask(frame)
        found = [b for b in boxes(masks[active]) if b[4] >= least_area]
        state.settle(len(found))
        return active, found
    return state.name, [b for b in boxes(state.mask(frame)) if b[4] >= least_area]


def ground_truth(frames: DataFrame, known: DataFrame) -> DataFrame:
    """Known boxes (video_id, frame_no, x, y, w, h) of the frames that there are, at most one a
    frame (the least in order of x, y, w, h), as detections; frames without one give no row."""
    one = known.groupBy("video_id", "frame_no").agg(F.min(F.struct("x", "y", "w", "h")).alias("b"))
    return frames.select("video_id", "frame_no").join(one, ["video_id", "frame_no"]).select(
        "video_id", "frame_no", F.lit(0).cast("long").alias("det_id"), *(F.col(f"b.{c}").cast("int").alias(c) for c in "xywh"), (F.col("b.w") * F.col("b.h")).cast("int").alias("area"), F.lit("ground_truth").alias("detector")
    )


def detect(frames: DataFrame, kind: str = "cascaded_fallback", least_area: int = 500, **how) -> DataFrame:
    """Boxes of each frame: video_id, frame_no, det_id (in the frame), x, y, w, h, area in pixels, detector.

    Frames whose bytes don't fit their size are skipped, as unreadable ones are.
    """
    make = Cascade if kind == Cascade.name else DETECTORS[kind]
    ready = frames.selectExpr("cast(video_id as long) video_id", "cast(frame_no as long) frame_no", "cast(height as int) height", "cast(width as int) width", "pixels").na.drop()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for v, no, h, w, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if v != video:
                    video, state = v, make(**how)
                if len(raw) != h * w:
                    continue
                name, found = stepped(state, np.frombuffer(raw, np.uint8).reshape(h, w), least_area)
                out += [(v, no, i, *b, name) for i, b in enumerate(found)]
            kinds = [pa.int64()] * 3 + [pa.int32()] * 5 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["video_id", "frame_no", "det_id", "x", "y", "w", "h", "area", "detector"])

    return ready.repartition("video_id").sortWithinPartitions("video_id", "frame_no").mapInArrow(run, OUT)


TRACKED = "video_id long, frame_no long, det_id long, track_id long, hits int, x int, y int, w int, h int, detector string, note string, value double"
DIAGNOSTICS = ("avg_mask_quality", "avg_track_quality", "avg_threshold_used", "adaptive_trigger_rate", "rerun_accept_rate", "n_frames")


def detect_and_track(frames: DataFrame, detector: str = "adaptive_mog2", tracker: str = "centroid", least_area: int = 500, settings: dict | None = None, tracking: dict | None = None) -> DataFrame:
    """Detector and tracker of each video step by step together: one row per box, and notes.

    After each frame the detector, if it has ``feedback``, is told the lengths of the living
    tracks and how many of them were matched, so it knows of a frame when it sees the
    next. A row with a ``note`` and null box tells a diagnostic of the video's detector
    (with its value), or at which of the video's frames the cascade went from one detector
    to another ("mog2>dense_flow"). Frames whose bytes don't fit their size are skipped.
    ``settings`` and ``tracking`` are those of the detector and of the tracker.
    """
    kind, settings, tracking = Cascade if detector == Cascade.name else DETECTORS[detector], settings or {}, tracking or {}
    ready = frames.selectExpr("cast(video_id as long) video_id", "cast(frame_no as long) frame_no", "cast(height as int) height", "cast(width as int) width", "pixels").na.drop()
    names = [c.split()[0] for c in TRACKED.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.int32()] * 5 + [pa.string(), pa.string(), pa.float64()]

    def notes(video: int | None, state) -> list[tuple]:
        switches = [(video, frame, *[None] * 7, state.name, f"{a}>{b}", None) for frame, a, b in getattr(state, "switches", [])]
        told = state.diagnostics() if hasattr(state, "diagnostics") else {}
        return switches + [(video, *[None] * 8, state.name, k, float(v)) for k, v in told.items()]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, state, tracks = None, None, None
        for batch in batches:
            out: list[tuple] = []
            for v, no, h, w, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if v != video:
                    out += notes(video, state) if state else []
                    video, state, tracks = v, kind(**settings), TRACKERS[tracker](**tracking)
                if len(raw) != h * w:
                    continue
                name, found = stepped(state, np.frombuffer(raw, np.uint8).reshape(h, w), least_area)
                ids, hits = tracks.update(no, np.array([b[:4] for b in found], float).reshape(-1, 4))
                if hasattr(state, "feedback"):
                    state.feedback(np.minimum(tracks.hits, MAX_POINTS).tolist(), int((tracks.missed == 0).sum()))
                out += [(v, no, i, t, n, *b[:4], name, None, None) for i, (t, n, b) in enumerate(zip(ids, hits, found, strict=True))]
            yield packed(out)
        if state:
            yield packed(notes(video, state))

    return ready.repartition("video_id").sortWithinPartitions("video_id", "frame_no").mapInArrow(run, TRACKED)


def adaptive_diagnostics(tracked: DataFrame) -> DataFrame:
    """One row per video of ``detect_and_track``'s diagnostics."""
    return tracked.where(F.col("note").isin(*DIAGNOSTICS)).groupBy("video_id").pivot("note", list(DIAGNOSTICS)).agg(F.first("value"))


def diagnostics_means(per_video: DataFrame) -> DataFrame:
    """One row: each diagnostic's mean over videos, and the number of videos."""
    return per_video.agg(F.count("*").alias("n_videos"), *(F.avg(c).alias(c) for c in DIAGNOSTICS))


def switch_log(tracked: DataFrame) -> DataFrame:
    """video_id, frame (counted from 1), detector_from, detector_to of the cascade's switches."""
    ends = F.split("note", ">")
    return tracked.where(F.col("note").contains(">")).select("video_id", F.col("frame_no").alias("frame"), ends[0].alias("detector_from"), ends[1].alias("detector_to"))


def overlay(tracked: DataFrame) -> DataFrame:
    """What an annotated video shows of each frame: its boxes with their track's label and
    length so far, whether that track is the video's longest, and the frame's number of boxes."""
    rows = tracked.where("track_id is not null")
    longest = rows.groupBy("video_id").agg(F.min(F.struct((-F.col("hits")).alias("n"), "track_id")).alias("best")).select("video_id", F.col("best.track_id").alias("longest"))
    n = F.count("*").over(Window.partitionBy("video_id", "frame_no"))
    return rows.join(longest, "video_id").select("video_id", "frame_no", "track_id", "x", "y", "w", "h", F.format_string("ID %d", "track_id").alias("label"), F.col("hits").alias("length"), (F.col("track_id") == F.col("longest")).alias("is_longest"), n.alias("n_boxes"))
