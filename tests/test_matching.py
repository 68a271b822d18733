"""Matches as joins against the trackers' assignment and against all assignments; functions for SQL."""

import itertools
import random

import numpy as np
import pytest

from motionlake.functions import kernels, tables
from motionlake.operators import matching, tracking, tracks
from motionlake.sources import views

SCHEMA = "video_id long, frame_no long, det_id long, x long, y long, w long, h long"


def made(seed, n=5, size=45):
    rng = random.Random(seed)
    return [(v, f, 10 * f + d, rng.randrange(size), rng.randrange(size), 20, 15 + rng.randrange(8)) for v in range(2) for f in (0, 1, 2, 4) for d in range(rng.randint(1, n))]


def shares(a, b):
    return tracking.iou_matrix(np.array([r[3:] for r in a], float), np.array([r[3:] for r in b], float))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_are_the_best_assignment(spark, seed):
    rows = made(seed)
    got = matching.matched(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    for v in range(2):
        for f in (0, 1):
            a, b = ([r for r in rows if r[:2] == (v, k)] for k in (f, f + 1))
            share = shares(a, b)
            short, flip = (share, False) if len(a) <= len(b) else (share.T, True)
            best = max(sum(short[i, p] for i, p in enumerate(perm)) for perm in itertools.permutations(range(short.shape[1]), short.shape[0]))
            own = [r for r in got if (r["video_id"], r["frame_no"]) == (v, f)]
            pairs = [(r["det_id"], r["next_det"]) for r in own]
            assert len({p[0] for p in pairs}) == len({p[1] for p in pairs}) == len(pairs) and flip in (True, False)
            places, found = tracking.best_overlaps(share, 0.3)
            assert sorted(pairs) == sorted((a[i][2], b[j][2]) for i, j in zip(places, found, strict=True))
            assert sum(share[i, j] for i, j in kernels.assign(-share)) == pytest.approx(best)
    assert not [r for r in got if r["frame_no"] in (2, 4)]  # no next frame
    alone = {tuple(r) for r in matching.settled(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {tuple(r)[:-1] for r in got if r["settled"]} == alone


def test_no_boxes(spark):
    assert matching.matched(spark.createDataFrame([], SCHEMA)).collect() == []


def test_table_function_equals_the_columns(spark, sf_dir):
    """Tracks of all lengths, also longer than an Arrow batch; scalar functions against their columns."""
    tables.register(spark)
    rng = random.Random(0)
    rows = [(0, t, i, rng.gauss(0, 9), float(i % 7)) for t, n in enumerate((1, 2, 3, 30, 25_000)) for i in range(n)] + [(1, 0, i, 4.0, 4.0) for i in range(5)]
    points = spark.createDataFrame(rows, "video_id long, track_id long, seq long, x double, y double")
    got = {tuple(r)[:2]: r for r in spark.sql("SELECT * FROM track_features(TABLE({points}) PARTITION BY (video_id, track_id) ORDER BY seq)", points=points.repartition(4)).collect()}
    want = {tuple(r)[:2]: r for r in tracks.trajectory_features(points).collect()}
    assert set(got) == set(want) and len(got) == 5
    for k, r in want.items():
        assert [got[k][c] for c in tables.MOTION] == pytest.approx([r[c] for c in tables.MOTION], rel=1e-9, abs=1e-9)
    said = spark.sql("SELECT box_iou(0, 0, 2, 2, 1, 1, 2, 2) AS a, box_iou(0, 0, 0, 0, 0, 0, 0, 0) AS b, turn_between(0.1D, 2 * pi() - 0.1D) AS c, centre_distance(0, 0, 3, 3, 3, 4, 3, 3) AS d").first()
    assert list(said) == pytest.approx([1 / 7, 0.0, 0.2, 5.0])
    assert views.track_points(spark, sf_dir).count() > 0
