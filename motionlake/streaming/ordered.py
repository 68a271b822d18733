"""Trackers over a stream in event time: frames are released in order as the watermark passes them.

Per video the state holds the boxes of frames that wait (a map by frame), the living
tracks (a list) and a clock; timers in event time release frames and end the state.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.tracking import MAX_GAP, OUT, TRACKERS, stepped

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLS = ["det_id", "x", "y", "w", "h"]
SCHEMA = f"{OUT}, late boolean"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


class Ordered(StatefulProcessor):
    """Releases a video's frames in order of their numbers and steps its tracker through them."""

    def __init__(self, kind: str, how: dict[str, Any], idle_ms: int):
        self.kind, self.how, self.idle_ms = kind, how, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "frame_no long", "at long, boxes array<long>")
        self.tracks = handle.getListState("tracks", "id long, missed long, hits long, x double, y double, w double, h double")
        self.clock = handle.getValueState("clock", "frame long, next_id long, at long, ends long")

    def _clock(self) -> tuple[int | None, int, int, int]:
        """The last frame released, the next track's id, the latest time seen and when the state ends."""
        return tuple(self.clock.get()) if self.clock.exists() else (None, 0, 0, 0)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frame, next_id, at, ends = self._clock()
        late: list[tuple] = []
        for part in rows:
            part = part.assign(ms=part["ts"].astype("datetime64[us]").astype("int64") // 1000)
            for number, own in part.groupby("frame_no"):
                if frame is not None and number <= frame:
                    late += [(key[0], int(number), int(d)) for d in own["det_id"]]
                    continue
                ms, boxes = int(own["ms"].max()), own[COLS].to_numpy(np.int64).ravel().tolist()
                if self.waiting.containsKey((int(number),)):
                    old = self.waiting.getValue((int(number),))
                    ms, boxes = max(ms, int(old[0])), [*map(int, old[1]), *boxes]
                self.waiting.updateValue((int(number),), (ms, boxes))
                self.handle.registerTimer(ms)
                at = max(at, ms)
        if at + self.idle_ms > ends:
            ends = at + self.idle_ms
            self.handle.registerTimer(ends)
        self.clock.update((frame, next_id, at, ends))
        if late:
            yield pd.DataFrame([(*k, None, None, None, None, True) for k in late], columns=_NAMES).astype({n: "Int64" for n in _NAMES[:-1]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        frame, next_id, at, ends = self._clock()
        now = timerValues.getCurrentWatermarkInMs()
        ready = sorted((int(k[0]), int(v[0]), list(v[1])) for k, v in self.waiting.iterator())
        # A frame waits for all before it; what the watermark has passed can't be added to.
        upto = max((i for i, r in enumerate(ready) if r[1] <= now), default=-1) + 1
        due = [r for r in ready[:upto] if r[1] <= now]
        if due:
            tracker = TRACKERS[self.kind](**self.how)
            living = list(self.tracks.get()) if self.tracks.exists() else []
            tracker.frame, tracker.next_id = frame, next_id
            tracker.ids, tracker.missed, tracker.hits = (np.array([int(t[i]) for t in living], int) for i in range(3))
            tracker.boxes = np.array([[float(v) for v in t[3:]] for t in living]).reshape(-1, 4)
            values = np.concatenate([np.hstack([np.full((len(b) // 5, 1), number), np.array(b, np.int64).reshape(-1, 5)]) for number, _, b in due])
            values = values[np.lexsort((values[:, 1], values[:, 0]))]
            found = stepped(tracker, values[:, 0], values[:, 1], values[:, 2:].astype(float))
            for number, _, _ in due:
                self.waiting.removeKey((number,))
            self.tracks.put([(int(i), int(m), int(h), *map(float, b)) for i, m, h, b in zip(tracker.ids, tracker.missed, tracker.hits, tracker.boxes, strict=True)])
            self.clock.update((int(tracker.frame), int(tracker.next_id), at, ends))
            out = pd.DataFrame(dict(zip(_NAMES[1:-1], found, strict=True)))
            out.insert(0, "video_id", key[0])
            yield out.assign(late=False)
        elif now >= ends and not ready:
            for state in (self.tracks, self.clock, self.waiting):
                state.clear()

    def close(self) -> None:
        pass


def track_ordered(detections: DataFrame, kind: str = "iou_hungarian", lateness: str = "10 seconds", idle_ms: int = 3_600_000, max_gap: int = MAX_GAP, **how) -> DataFrame:
    """The rows of ``tracking.track`` for a stream of detections with a column ``ts``, and ``late``.

    Rows may come in any order: a frame is tracked once the watermark, ``lateness`` behind
    the latest ``ts``, has passed it, in order of the frames' numbers. Rows of a frame that
    has been tracked come out with ``late`` and without a track; Spark itself drops rows
    before the watermark. A video without rows for ``idle_ms`` of event time begins anew.
    ``kind`` is centroid or iou_hungarian, whose tracks are boxes and counts alone. Append
    mode; sets the session's state store to the one that typed state needs.
    """
    if kind not in ("centroid", "iou_hungarian"):
        raise ValueError(f"no typed state for {kind}")
    detections.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    cols = [f"cast({c} as long) {c}" for c in ("video_id", "frame_no", *COLS)]
    ready = detections.selectExpr(*cols, "cast(ts as timestamp) ts").na.drop().withWatermark("ts", lateness)
    return ready.groupBy("video_id").transformWithStateInPandas(Ordered(kind, {"max_gap": max_gap, **how}, idle_ms), SCHEMA, "append", "eventTime")
