"""Trackers as a stateful stream: one state per video, the same steps as in batch."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.tracking import OUT, TRACKERS, stepped

COLS = ["frame_no", "det_id", "x", "y", "w", "h"]


def track_stream(detections: DataFrame, kind: str = "iou_hungarian", idle_ms: int = 3_600_000, **how) -> DataFrame:
    """One row per detection, as ``tracking.track``; append mode.

    Within a micro-batch a video's rows are sorted by frame; a frame must come whole,
    and rows of a frame that has been passed are dropped as late. The state, a tracker
    and its last frame, is bounded by the tracks that are alive, and is dropped after
    ``idle_ms`` of processing time without a row; a video that comes back begins anew.
    """
    make = TRACKERS[kind]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tracker = pickle.loads(state.get[0]) if state.exists else make(**how)
        rows = pd.concat(list(parts)).sort_values(["frame_no", "det_id"])
        if tracker.frame is not None:
            rows = rows[rows["frame_no"] > tracker.frame]
        values = rows[COLS].to_numpy(np.int64)
        state.setTimeoutDuration(idle_ms)
        if len(values):
            found = stepped(tracker, values[:, 0], values[:, 1], values[:, 2:].astype(float))
            out = pd.DataFrame(dict(zip(["frame_no", "det_id", "track_id", "hits", "cx", "cy"], found, strict=True)))
            out.insert(0, "video_id", key[0])
            state.update((pickle.dumps(tracker),))
            yield out

    ready = detections.selectExpr("cast(video_id as long) video_id", *(f"cast({c} as long) {c}" for c in COLS)).na.drop()
    return ready.groupBy("video_id").applyInPandasWithState(step, OUT, "tracker binary", "append", GroupStateTimeout.ProcessingTimeTimeout)
