import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from motionlake.functions import kernels


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10**6))
def test_assign_is_best(n, m, seed):
    cost = np.random.default_rng(seed).integers(-20, 20, (n, m)).astype(float)
    pairs = kernels.assign(cost)
    k = min(n, m)
    assert len({r for r, _ in pairs}) == len({c for _, c in pairs}) == len(pairs) == k
    best = min(sum(cost[r, c] for r, c in zip(rows, cols, strict=True)) for rows in itertools.combinations(range(n), k) for cols in itertools.permutations(range(m), k))
    assert sum(cost[r, c] for r, c in pairs) == pytest.approx(best)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 50), st.integers(0, 20), st.integers(0, 20)), min_size=2, max_size=6))
def test_iou_is_symmetric_and_bounded(boxes):
    a = np.array(boxes, float)
    m = kernels.iou_matrix(a, a)
    assert np.allclose(m, m.T) and (m >= 0).all() and (m <= 1 + 1e-12).all()


def test_hull():
    square = np.array([[0, 0], [2, 0], [2, 2], [0, 2], [1, 1], [2, 1]], float)
    assert kernels.hull(square) == (4.0, 8.0)
    assert kernels.hull(np.array([[0, 0], [1, 1], [2, 2]], float)) == (0.0, 0.0)


def test_wavelet_keeps_the_mean_and_drops_constant_detail():
    energy = kernels.wavelet_energies(np.full(20, 3.0))
    assert energy[1:] == pytest.approx([0, 0, 0], abs=1e-9) and energy[0] > 0
    assert sum(kernels.DB4) == pytest.approx(2**0.5) and (kernels.DB4**2).sum() == pytest.approx(1)


def test_boxes_and_morphology():
    mask = np.zeros((12, 12), bool)
    mask[1:4, 1:5] = True
    mask[7:10, 6:9] = True
    assert kernels.boxes(mask) == [(1, 1, 4, 3, 12), (6, 7, 3, 3, 9)]
    ring = mask.copy()
    ring[8, 7] = False
    assert kernels.eroded(kernels.dilated(ring))[8, 7]
    snake = np.zeros((5, 5), bool)
    snake[0, :] = snake[:, 4] = snake[4, :] = True
    assert len(kernels.boxes(snake)) == 1


def test_block_flow_finds_a_shift():
    before = np.random.default_rng(1).integers(0, 255, (32, 32)).astype(np.uint8)
    now = np.roll(before, (1, 2), (0, 1))
    inner = kernels.block_flow(before, now).reshape(4, 4, 4)[1:3, 1:3]
    assert (inner[..., 2] == 2).all() and (inner[..., 3] == 1).all()


def test_hull_and_wavelet_take_whole_tracks(spark):
    from motionlake.operators import shapes

    rng = np.random.default_rng(5)
    tracks = {t: rng.normal(size=(n, 2)).cumsum(axis=0) for t, n in enumerate([3, 4, 15, 16, 17, 40, 257, 258, 900])}
    points = spark.createDataFrame([(t % 2, t, i, float(x), float(y)) for t, xy in tracks.items() for i, (x, y) in enumerate(xy)], "video_id long, track_id long, seq long, x double, y double")
    for how in ({}, {"block": 7}):
        got = {r.track_id: r for r in shapes.hull_features(points, **how).collect()}
        assert sorted(got) == [t for t, xy in tracks.items() if len(xy) >= 4]
        for t, r in got.items():
            area, around = kernels.hull(tracks[t])
            assert (r.convex_hull_area, r.compactness) == pytest.approx((area, 4 * np.pi * area / around**2)), t
    for least in (2, 15):
        got = {r.track_id: r for r in shapes.wavelet_features(points, 10.0, least).collect()}
        assert sorted(got) == [t for t, xy in tracks.items() if len(xy) >= least]
        for t, r in got.items():
            want = kernels.wavelet_energies(np.hypot(*np.diff(tracks[t], axis=0).T) * 10.0)
            assert list(r)[2:6] == pytest.approx(want) and r.dwt_energy_total == pytest.approx(sum(want)), t
