"""The nearest rows by pairs of blocks against all distances."""

import numpy as np
import pytest

from motionlake.operators import learn


def _all(ids, x, k):
    out = []
    for i, v in zip(ids, x, strict=True):
        d = np.sqrt(((x - v) ** 2).sum(1))
        near = [j for j in np.lexsort((ids, d)) if ids[j] != i and np.isfinite(d[j])][:k]
        out += [(int(i), int(ids[j]), p + 1, round(float(d[j]), 6)) for p, j in enumerate(near)]
    return sorted(out)


def _found(spark, ids, x, block, k=5):
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    return sorted((r["id"], r["other"], r["place"], round(r["distance"], 6)) for r in learn.nearest(rows, rows, k, block=block).collect())


@pytest.mark.parametrize("block", [300, 2048])
def test_copies_are_at_distance_zero_in_order_of_ids(spark, block):
    rng = np.random.default_rng(3)
    x = 1000 * rng.standard_normal((1900, 64))
    x[rng.choice(1900, 12, replace=False)] = x[0]
    x[rng.choice(1900, 4, replace=False)] *= 1e-3
    ids = rng.permutation(4000)[:1900]
    assert _found(spark, ids, x, block) == _all(ids, x, 5)


def test_few_rows_vast_values_and_values_that_are_no_numbers(spark):
    x = np.array([[0.0, 1.0], [1e200, 0.0], [3e19, 1.0], [3e19, 2.0], [0.0, 1.0], [np.nan, 0.0], [1e18, 0.0]])
    fine = np.array([0, 2, 3, 4, 6])
    assert _found(spark, np.arange(7), x, 3) == _all(fine, x[fine], 5)


def test_later_blocks_are_ruled_out_by_their_products(monkeypatch):
    """A block that holds nothing near has no exact distance taken."""
    rng, taken = np.random.default_rng(5), []
    near = learn.Nearest(np.arange(50), rng.standard_normal((50, 8)), 5)
    near.see(np.arange(50), near.vectors)
    monkeypatch.setattr(near, "_keep", lambda i, ids, v: taken.append(len(i)))
    near.see(np.arange(100, 400), 100 + rng.standard_normal((300, 8)))
    assert not taken
