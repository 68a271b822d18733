"""Trackers: detections of each video, frame by frame, to track ids.

A tracker is a small state that takes one frame's boxes and names each box's track.
In batch, rows are dealt out by video and sorted by frame, and each task steps
through its rows with one state at a time, so memory is bounded by the tracks that
are alive, not by the video. The stream form keeps the same state per video.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import assign, iou_matrix

MAX_GAP, MAX_POINTS = 30, 300
OUT = "video_id long, frame_no long, det_id long, track_id long, hits int, cx long, cy long"


class Tracker:
    """Common part: ids from 0 in order of creation; tracks end after ``max_gap`` missed frames.

    What is known of the living tracks is held in arrays, one place a track, so a frame
    is handled at once however many tracks there are.
    """

    def __init__(self, max_gap: int = MAX_GAP):
        self.max_gap = max_gap
        self.ids, self.missed, self.hits, self.boxes = np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), np.zeros((0, 4))
        self.next_id, self.frame = 0, None

    def pairs(self, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Track places and box places of the frame's matches."""
        raise NotImplementedError

    def begin(self) -> None:
        """Called for each frame before matching."""

    def started(self, boxes: np.ndarray) -> None:
        """Called with the boxes of new tracks, the first of which gets ``next_id``."""

    def matched(self, places: np.ndarray, boxes: np.ndarray) -> np.ndarray:
        """Called for a frame's matches; the boxes that the tracks have from now on."""
        return boxes[:, :4]

    def ended(self, stay: np.ndarray) -> None:
        """Called with the places of the tracks that stay."""

    def skip(self, frames: int) -> None:
        """Frames without any box."""
        for _ in range(min(frames, self.max_gap + 1)):
            self.begin()
            self.missed += 1
            self._prune()

    def _prune(self) -> None:
        stay = np.flatnonzero(self.missed <= self.max_gap)
        if len(stay) < len(self.ids):
            self.ids, self.missed, self.hits, self.boxes = self.ids[stay], self.missed[stay], self.hits[stay], self.boxes[stay]
            self.ended(stay)

    def update(self, frame: int, boxes: np.ndarray) -> tuple[list[int], list[int]]:
        """Track id and number of hits of each box of the next frame."""
        if self.frame is not None and frame > self.frame + 1:
            self.skip(frame - self.frame - 1)
        self.frame = frame
        self.begin()
        names, hits = np.full(len(boxes), -1), np.ones(len(boxes), int)
        places, found = self.pairs(boxes) if len(self.ids) and len(boxes) else (np.zeros(0, int), np.zeros(0, int))
        self.missed += 1
        if len(places):
            self.boxes[places] = self.matched(places, boxes[found])
            self.missed[places] = 0
            self.hits[places] += 1
            names[found], hits[found] = self.ids[places], self.hits[places]
        new = np.flatnonzero(names < 0)
        if len(new):
            self.started(boxes[new])
            names[new] = np.arange(self.next_id, self.next_id + len(new))
            self.next_id += len(new)
            self.ids, self.missed, self.hits = np.append(self.ids, names[new]), np.append(self.missed, 0 * new), np.append(self.hits, 0 * new + 1)
            self.boxes = np.vstack([self.boxes, boxes[new, :4]])
        self._prune()
        return names.tolist(), hits.tolist()


def centres(boxes: np.ndarray) -> np.ndarray:
    return boxes[:, :2] + np.floor(boxes[:, 2:4] / 2)


class Centroid(Tracker):
    """Nearest centres first, over all pairs; ties by track, then box.

    Distances are compared as squares, which are whole numbers: roots of equal ones may differ.
    """

    def pairs(self, boxes):
        gap = centres(self.boxes)[:, None, :] - centres(boxes)[None, :, :]
        d = (gap * gap).sum(-1)
        rows, cols = [], []
        for _ in range(min(d.shape)):  # the least left, at first in reading order
            r, c = divmod(int(d.argmin()), d.shape[1])
            rows.append(r)
            cols.append(c)
            d[r], d[:, c] = np.inf, np.inf
        return np.array(rows, int), np.array(cols, int)


def best_overlaps(share: np.ndarray, above: float, bonus: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the assignment with the greatest total share that overlap by more than ``above``.

    Only tracks and boxes that overlap something take part: the others add nothing to a
    total, and there are at least as many on the longer side as the shorter one needs.
    """
    rows, cols = np.flatnonzero((share > 0).any(1)), np.flatnonzero((share > 0).any(0))
    if not len(rows):
        return rows, cols[:0]
    own = share[np.ix_(rows, cols)]
    cost = -own - (bonus[np.ix_(rows, cols)] if isinstance(bonus, np.ndarray) else 0.0)
    found = np.array([(r, c) for r, c in assign(cost) if own[r, c] > above], int).reshape(-1, 2)
    return rows[found[:, 0]], cols[found[:, 1]]


class Overlap(Tracker):
    """Best total overlap; a pair counts if it overlaps by more than ``above``."""

    def __init__(self, max_gap: int = MAX_GAP, above: float = 0.3):
        super().__init__(max_gap)
        self.above = above

    def expected(self) -> np.ndarray:
        return self.boxes

    def pairs(self, boxes):
        return best_overlaps(iou_matrix(self.expected(), boxes[:, :4]), self.above)


class Sort(Overlap):
    """Overlap with boxes predicted by a constant-velocity Kalman filter per track.

    The state is centre, area, aspect and the speeds of the first three; a prediction
    without a valid box falls back to the last box. All tracks' filters are one stack
    of matrices.
    """

    MOVE = np.eye(7) + np.eye(7, k=4)
    NOISE = np.diag([0.03] * 4 + [0.0003] * 3)
    BLUR = np.diag([0.3, 0.3, 0.03, 0.03])

    def __init__(self, max_gap: int = MAX_GAP, above: float = 0.3):
        super().__init__(max_gap, above)
        self.mean, self.cov = np.zeros((0, 7)), np.zeros((0, 7, 7))

    @staticmethod
    def measured(boxes: np.ndarray) -> np.ndarray:
        x, y, w, h = boxes[:, :4].T
        return np.stack([x + w / 2, y + h / 2, w * h, np.where(h > 0, w / np.where(h > 0, h, 1), 1.0)], axis=1)

    def begin(self):
        self.mean = self.mean @ self.MOVE.T
        self.cov = self.MOVE @ self.cov @ self.MOVE.T + self.NOISE

    def expected(self):
        valid = (self.mean[:, 2] > 0) & (self.mean[:, 3] > 0)
        area, aspect = np.where(valid, self.mean[:, 2], 1.0), np.where(valid, self.mean[:, 3], 1.0)
        w = np.sqrt(area * aspect)
        h = area / w
        return np.where(valid[:, None], np.trunc(np.stack([self.mean[:, 0] - w / 2, self.mean[:, 1] - h / 2, w, h], axis=1)), self.boxes)

    def started(self, boxes):
        self.mean = np.vstack([self.mean, np.hstack([self.measured(boxes), np.zeros((len(boxes), 3))])])
        self.cov = np.concatenate([self.cov, np.repeat(10.0 * np.eye(7)[None], len(boxes), axis=0)])

    def matched(self, places, boxes):
        c = self.cov[places]
        gain = c[:, :, :4] @ np.linalg.inv(c[:, :4, :4] + self.BLUR)  # the first four of the state are what is seen
        self.mean[places] += (gain @ (self.measured(boxes) - self.mean[places, :4])[..., None])[..., 0]
        self.cov[places] = c - gain @ c[:, :4, :]
        return boxes[:, :4]

    def ended(self, stay):
        self.mean, self.cov = self.mean[stay], self.cov[stay]


class Focused(Overlap):
    """Overlap, with an online appearance model per track that is drawn to its target.

    The model w answers a box's look p with w.p; after each match it takes a step down
    the gradient ``2 ((1 - eta) w.p - 1) p + 2 lam w``, longer the better the overlap.
    It starts from small weights that depend on the track's number only. Among pairs
    of equal overlap the better answer wins. Boxes carry their looks after x, y, w, h,
    nine numbers for each of ``scales``; a matched track keeps the box, scaled about its
    centre, whose look its model answers best (of equals the first).
    """

    def __init__(self, max_gap: int = MAX_GAP, above: float = 0.3, eta: float = 0.5, lam: float = 1e-4, rate: float = 0.02, scales: tuple[float, ...] = (1.0,)):
        super().__init__(max_gap, above)
        self.eta, self.lam, self.rate, self.scales, self.weights = eta, lam, rate, scales, np.zeros((0, LOOK))

    def looks(self, boxes: np.ndarray) -> np.ndarray:
        """[box, scale, look]; all zero where boxes carry none."""
        out = np.zeros((len(boxes), len(self.scales), LOOK))
        return boxes[:, 4:].reshape(out.shape) if boxes.shape[1] == 4 + out[0].size else out

    def _plain(self, boxes: np.ndarray) -> np.ndarray:
        return self.looks(boxes)[:, self.scales.index(1.0)]

    def pairs(self, boxes):
        answer = np.clip(self.weights @ self._plain(boxes).T, -1, 1)
        return best_overlaps(iou_matrix(self.expected(), boxes[:, :4]), self.above, 1e-9 * answer)

    def started(self, boxes):
        new = [np.random.default_rng(self.next_id + i).standard_normal(LOOK) * 0.01 for i in range(len(boxes))]
        self.weights = np.vstack([self.weights, *new])

    def matched(self, places, boxes):
        w, p = self.weights[places], self._plain(boxes)
        best = np.einsum("bl,bsl->bs", w, self.looks(boxes)).argmax(1)
        share = iou_matrix(self.boxes[places], boxes[:, :4]).diagonal()
        slope = 2 * ((1 - self.eta) * (w * p).sum(1) - 1)
        self.weights[places] = w - (self.rate * (0.5 + 0.5 * share))[:, None] * (slope[:, None] * p + 2 * self.lam * w)
        return scaled(boxes[:, :4], np.array(self.scales)[best])

    def ended(self, stay):
        self.weights = self.weights[stay]


LOOK = 9
TRACKERS: dict[str, Callable[..., Tracker]] = {"centroid": Centroid, "iou_hungarian": Overlap, "sort": Sort, "tfcr": Focused}


def scaled(boxes: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Boxes scaled about their centres to whole pixels, at least 4 wide and high, from 0 on; by 1 unchanged."""
    size = np.maximum(4, np.trunc(boxes[:, 2:] * by[:, None]))
    corner = np.maximum(0, centres(boxes) - np.floor(size / 2))
    return np.where((by == 1)[:, None], boxes, np.hstack([corner, size]))


def stepped(tracker: Tracker, frame_no: np.ndarray, det_id: np.ndarray, box: np.ndarray) -> list[np.ndarray]:
    """Columns frame_no, det_id, track_id, hits, cx, cy of whole frames in order."""
    names, hits = [], []
    for start, stop in zip(*_runs(frame_no), strict=True):
        named, hit = tracker.update(int(frame_no[start]), box[start:stop])
        names += named
        hits += hit
    mid = centres(box).astype(np.int64)
    return [frame_no, det_id, np.array(names, np.int64), np.array(hits, np.int32), mid[:, 0], mid[:, 1]]


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.append(0, edges), np.append(edges, len(values))


def track(detections: DataFrame, kind: str = "iou_hungarian", **how) -> DataFrame:
    """One row per detection: video_id, frame_no, det_id, track_id, hits so far, and the box's centre.

    Detections of a frame are taken in order of det_id; frame numbers without a
    detection are empty frames. Rows with a null video, frame or box are left out. The
    appearance tracker reads ``look`` (nine numbers a scale) if there is such a column.
    """
    return _tracked(detections, {kind: lambda: TRACKERS[kind](**how)}, LOOK * len(how.get("scales", (1.0,)))).drop("tracker")


def track_all(detections: DataFrame, kinds: Sequence[str] = tuple(TRACKERS)) -> DataFrame:
    """The rows of ``track`` for each of ``kinds``, with a column tracker; the detections are
    dealt out, sorted and read once."""
    return _tracked(detections, {k: TRACKERS[k] for k in kinds}, LOOK)


def _tracked(detections: DataFrame, makers: dict[str, Callable[[], Tracker]], looks: int) -> DataFrame:
    cols = ["video_id", "frame_no", "det_id", "x", "y", "w", "h"]
    whole = [F.col(c).cast("long").alias(c) for c in cols]
    if "tfcr" in makers and "look" in detections.columns:  # looks travel as millionths
        whole += [F.coalesce(F.round(F.get("look", F.lit(i)) * 1e6), F.lit(0)).cast("long").alias(f"look{i}") for i in range(looks)]
    ready, width = detections.select(*whole).na.drop(), len(whole)

    def named(video: int, states: dict[str, Tracker], rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        boxes = rows[:, 3:].astype(float)
        boxes[:, 4:] /= 1e6
        for kind, state in states.items():
            found = stepped(state, rows[:, 1].copy(), rows[:, 2].copy(), boxes)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), video)), *map(pa.array, found), pa.array([kind] * len(rows), pa.string())], [*(c.split()[0] for c in OUT.split(", ")), "tracker"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, states, held = None, {}, np.zeros((0, width), np.int64)
        for batch in _ended(batches):
            rows = held if batch is None else np.vstack([held, np.stack([c.to_numpy() for c in batch.columns], axis=1)])
            # The last frame may go on in the next batch.
            last = np.flatnonzero((rows[:, :2] != rows[-1:, :2]).any(1))
            cut = len(rows) if batch is None else last[-1] + 1 if len(last) else 0
            rows, held = rows[:cut], rows[cut:]
            for start, stop in zip(*_runs(rows[:, 0]), strict=True) if len(rows) else ():
                if rows[start, 0] != video:
                    video, states = rows[start, 0], {k: make() for k, make in makers.items()}
                yield from named(video, states, rows[start:stop])

    return ready.repartition("video_id").sortWithinPartitions("video_id", "frame_no", "det_id").mapInArrow(run, f"{OUT}, tracker string")


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches, and None at the end."""
    yield from batches
    yield None


def alive(tracked: DataFrame, frames: DataFrame | None = None, max_gap: int = MAX_GAP, min_hits: int = 1, most: int = MAX_POINTS) -> DataFrame:
    """Points (video_id, track_id, seq, x, y, disappeared) of the tracks that live at their video's end.

    A track's points are its matches, the last ``most`` of them, numbered from 0; tracks
    that ended before, or with fewer than ``min_hits`` matches, give none. ``frames``
    (video_id, frame_no) tells where videos end; else it is the last detection.
    """
    ends = (tracked if frames is None else frames).groupBy("video_id").agg(F.max("frame_no").alias("end"))
    last = tracked.groupBy("video_id", "track_id").agg(F.max("frame_no").alias("last"), F.count("*").alias("n"))
    living = last.join(ends, "video_id").withColumn("disappeared", F.col("end") - F.col("last")).where((F.col("disappeared") <= max_gap) & (F.col("n") >= min_hits))
    place = F.row_number().over(Window.partitionBy("video_id", "track_id").orderBy("frame_no"))
    points = tracked.join(living.select("video_id", "track_id", "disappeared", "n"), ["video_id", "track_id"]).withColumn("place", place - 1 - F.greatest(F.col("n") - most, F.lit(0)))
    return points.where("place >= 0").select("video_id", "track_id", F.col("place").cast("long").alias("seq"), F.col("cx").cast("double").alias("x"), F.col("cy").cast("double").alias("y"), "disappeared")
