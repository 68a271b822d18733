"""The kernel machine against the exact dual of each pair, solved by coordinate steps on pairs of rows."""

import random

import numpy as np
import pytest

from motionlake.learning import kernel

SCHEMA = "id long, label int, features array<double>"


def made(n=110, seed=0, classes=3):
    """Rings, which no plane divides."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = rng.choices(range(classes), [5, 3, 2][:classes])[0]
        turn, far = rng.uniform(0, 2 * np.pi), 1.0 + y + rng.gauss(0, 0.25)
        rows.append((i, y, [float(far * np.cos(turn)), float(far * np.sin(turn))]))
    return rows


def exact(x, y, c, gamma, turns=20000):
    """Dual coefficients and bias of the hinge machine with bias: the pair that violates most is moved."""
    k = kernel.radial(x, x, gamma)
    a, grad = np.zeros(len(y)), -np.ones(len(y))
    for _ in range(turns):
        up, low = ((y > 0) & (a < c)) | ((y < 0) & (a > 0)), ((y > 0) & (a > 0)) | ((y < 0) & (a < c))
        s = -y * grad
        i, j = np.where(up, s, -np.inf).argmax(), np.where(low, s, np.inf).argmin()
        if s[i] - s[j] < 1e-6:
            break
        step = (s[i] - s[j]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        step = min(step, c[i] - a[i] if y[i] > 0 else a[i], a[j] if y[j] > 0 else c[j] - a[j])
        a[i] += y[i] * step
        a[j] -= y[j] * step
        grad += y * step * (k[:, i] - k[:, j])
    free = (a > 1e-8) & (a < c - 1e-8)
    b = (-y * grad)[free].mean() if free.any() else ((-y * grad)[up].max() + (-y * grad)[low].min()) / 2
    value = 0.5 * a @ ((y[:, None] * y) * k) @ a - a.sum()
    return a * y, b, -value


def test_equals_the_exact_machine(spark):
    rows, unseen = made(), made(150, 5)
    gamma, cost = 0.5, 10.0
    model = kernel.fit(spark.createDataFrame(rows, SCHEMA).repartition(3), cost, gamma, landmarks=500)
    xs, ys = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    far = np.array([r[2] for r in unseen])
    weight = np.array([len(ys) / (3 * (ys == k).sum()) for k in range(3)])
    values, want = model.values(far), np.zeros((len(far), 3))
    for p, (i, j) in enumerate(model.pairs):
        own = (ys == i) | (ys == j)
        y = np.where(ys[own] == i, 1.0, -1.0)
        c = cost * weight[ys[own]]
        coef, b, optimum = exact(xs[own], y, c, gamma)
        want[:, p] = kernel.radial(far, xs[own], gamma) @ coef + b
        w = model.weights[:, p]
        hinge = np.maximum(0, 1 - y * (model.features(xs[own]) @ w[:-1] + w[-1]))
        assert 0.5 * w[:-1] @ w[:-1] + (c * hinge).sum() == pytest.approx(optimum, rel=0.01)
    assert (model.labels(values) == model.labels(want)).mean() >= 0.99
    assert (model.labels(values) == np.array([r[1] for r in unseen])).mean() > 0.85


def test_probabilities_and_landmarks(spark):
    rows, unseen = made(260), made(200, 7)
    df = spark.createDataFrame(rows, SCHEMA)
    model = kernel.fit(df, landmarks=60)
    assert len(model.landmarks) == 60 and model.gamma == pytest.approx(kernel.spread(df))
    again = kernel.Machine.read(model.table(spark))
    said = {r["id"]: r for r in kernel.predicted(spark.createDataFrame(unseen, SCHEMA), again).collect()}
    p = np.array([said[r[0]]["probability"] for r in unseen])
    truth = np.array([r[1] for r in unseen])
    assert np.allclose(p.sum(1), 1) and (p >= 0).all()
    assert -np.log(p[range(len(p)), truth]).mean() < 0.6 * np.log(3)
    assert np.mean([said[r[0]]["label"] == r[1] for r in unseen]) > 0.8
    assert (p.argmax(1) == [said[r[0]]["label"] for r in unseen]).mean() > 0.9


def test_coupling_gives_back_what_pairs_were_made_from():
    p = np.array([[0.5, 0.3, 0.2], [0.1, 0.1, 0.8]])
    m = kernel.Machine(3, np.zeros((0, 1)), 1.0, np.zeros((0, 0)), np.zeros((1, 3)), np.array([[-1.0] * 3, [0.0] * 3]))
    share = np.stack([p[:, i] / (p[:, i] + p[:, j]) for i, j in m.pairs], 1)
    assert np.allclose(m.probabilities(np.log(share / (1 - share))), p, atol=1e-6)


def test_one_class_and_no_rows(spark):
    one = kernel.fit(spark.createDataFrame([(1, 0, [1.0]), (2, 0, [2.0])], SCHEMA))
    assert kernel.predicted(spark.createDataFrame([(5, 0, [3.0])], SCHEMA), one).first().asDict() == {"id": 5, "label": 0, "probability": [1.0]}
    none = kernel.fit(spark.createDataFrame([], SCHEMA))
    assert kernel.predicted(spark.createDataFrame([(5, 0, [3.0])], SCHEMA), none).first()["probability"] == []
