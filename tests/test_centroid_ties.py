"""One track and two boxes that are equally far from it."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from motionlake.operators.tracking import Centroid
from motionlake.plans import catalog

#: Equal squares, whose rounded roots may differ.
STEPS = [((45, 43), (57, 25)), ((52, 17), (47, 28)), ((62, 61), (82, 29)), ((62, 61), (83, 26)), ((62, 61), (86, 13)), ((77, 76), (107, 16))]


@pytest.mark.parametrize("one, two", STEPS)
def test_equal_distances_go_to_the_first_box(one, two):
    tracker = Centroid()
    tracker.update(0, np.array([[200, 200, 10, 10]]))
    assert tracker.update(1, np.array([[200 + x, 200 + y, 10, 10] for x, y in (one, two)]))[0] == [0, 1]


def test_video_features_with_a_tie_equal_sql(spark, tmp_path):
    (one, two), far = STEPS[0], (1500, 1500)
    rows = []
    for frame in range(20):
        step, turn = (frame - 1) * 5 + frame * frame % 7, frame * frame % 5
        moved = [(200 + one[0] + step, 200 + one[1] + turn), (200 + two[0] - turn, 200 + two[1] - step), (far[0] + step, far[1] + step)] if frame else [(200, 200), (3000, 3000), far]
        for x, y in moved:
            i = len(rows)
            rows.append((i, i, 0, float(x - (20 + i % 40) // 2), f'{{"k": {y - (20 + i % 30) // 2}}}'))
    for i, (x, y) in ((3, one), (4, two)):  # the first step to the two is as long as that to the one
        rows[i] = (i, i, 0, float(200 + x - (20 + i) // 2), f'{{"k": {200 + y - (20 + i) // 2}}}')
    table = spark.createDataFrame(rows, "event_id long, ts long, user_id long, value double, props string").withColumn("ts", F.timestamp_seconds("ts").cast("timestamp_ntz"))
    table.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    engine = duckdb.connect()
    engine.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    found = catalog.QUERIES["tracked_video_features"](spark, str(tmp_path)).collect()
    want = engine.execute(catalog.ORACLE_SQL["tracked_video_features"])
    names = [c[0] for c in want.description]
    assert [[r[n] for n in names] for r in found] == [pytest.approx(list(r), abs=2e-6, nan_ok=True) for r in want.fetchall()]
