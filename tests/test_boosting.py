"""Boosting against a plain version that keeps all rows in lists and grows each tree leaf by leaf."""

import math
import random

import numpy as np
import pytest

from motionlake.learning import boosting

SCHEMA = "id long, label int, features array<double>"


def made(n=150, seed=0, classes=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = rng.choices(range(classes), [5, 2, 1][:classes])[0]
        rows.append((i, y, [rng.gauss(y, 1.0), float(rng.randrange(5)), rng.gauss(-y * (i % 2), 0.7), 1.0]))
    return rows


def plain(rows, edges, how, classes):
    """Scores of all rows after each round."""
    xs, ys = [r[2] for r in rows], [r[1] for r in rows]
    counts = [ys.count(k) for k in range(classes)]
    w = [len(ys) / (classes * counts[y]) if how.weight == "balanced" else max(counts) / counts[y] for y in ys]
    mass = [sum(wi for wi, y in zip(w, ys, strict=True) if y == k) for k in range(classes)]
    start = [math.log(m / sum(mass)) for m in mass] if how.from_shares else [0.0] * classes
    score = [list(start) for _ in rows]
    factor = how.factor or classes / (classes - 1)
    worth = lambda g, h: g * g / (h + how.l2)
    for _ in range(how.rounds):
        ps = [[math.exp(s) / sum(map(math.exp, ss)) for s in ss] for ss in score]
        for k in range(classes):
            g = [(p[k] - (y == k)) * wi for p, y, wi in zip(ps, ys, w, strict=True)]
            h = [factor * p[k] * (1 - p[k]) * wi for p, wi in zip(ps, w, strict=True)]

            def split(own, depth, g=g, h=h):
                best = None
                if depth == how.depth:
                    return None
                G, H = sum(g[i] for i in own), sum(h[i] for i in own)
                for f in range(len(xs[0])):
                    for e in edges[f]:
                        left = [i for i in own if xs[i][f] <= e]
                        if min(len(left), len(own) - len(left)) < max(how.min_rows, 1):
                            continue
                        gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                        if min(hl, H - hl) < how.min_hessian:
                            continue
                        gain = round(worth(gl, hl) + worth(G - gl, H - hl) - worth(G, H), 9)
                        if gain > 0 and (best is None or gain > best[0]):
                            best = gain, f, e
                return best

            tips = [(list(range(len(rows))), 0, 1)]
            while how.leaves is None or len(tips) < how.leaves:
                gains = [(s[0], -node, own, depth, node, s) for own, depth, node in tips if (s := split(own, depth))]
                if not gains:
                    break
                _, _, own, depth, node, (_, f, e) = max(gains, key=lambda t: t[:2])
                tips = [t for t in tips if t[2] != node]
                tips += [([i for i in own if xs[i][f] <= e], depth + 1, 2 * node), ([i for i in own if xs[i][f] > e], depth + 1, 2 * node + 1)]
            for own, _, _ in tips:
                value = -how.rate * sum(g[i] for i in own) / (sum(h[i] for i in own) + how.l2)
                for i in own:
                    score[i][k] += value
    return np.array(score)


@pytest.mark.parametrize("how", [boosting.leaf_wise(rounds=3, leaves=4, depth=4, min_rows=5), boosting.level_wise(rounds=3, depth=3, bins=16), boosting.leaf_wise(rounds=12, leaves=3, depth=2, min_rows=10, bins=8)])
def test_boosting(spark, how):
    rows = made(90)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    model = boosting.fit(df, how)
    want = plain(rows, model.edges, how, 3)
    got = model.scores(model.binned(np.array([r[2] for r in rows])))
    assert np.allclose(got, want, atol=1e-6)
    assert len(model.rounds) == how.rounds and all((t.feature >= 0).sum() < (how.leaves or 1 << how.depth) for ts in model.rounds for t in ts)
    again = boosting.Booster.read(model.table(spark))
    assert np.allclose(again.scores(again.binned(np.array([r[2] for r in rows]))), got)
    said = {r["id"]: r["probability"] for r in boosting.probabilities(df, again).collect()}
    assert np.allclose([said[r[0]] for r in rows], boosting.softmax(got)) and model.importances()[3] == 0


def test_rounds_go_on_after_scores_are_written(spark):
    """Twenty-two rounds, over two writes of the scores, are those of the plain version."""
    rows, unseen = made(100, classes=2), made(200, 9, classes=2)
    how = boosting.leaf_wise(rounds=22, leaves=6, min_rows=5, bins=12)
    model = boosting.fit(spark.createDataFrame(rows, SCHEMA), how)
    got = model.scores(model.binned(np.array([r[2] for r in rows])))
    assert np.allclose(got, plain(rows, model.edges, how, 2), atol=1e-6)
    far = model.scores(model.binned(np.array([r[2] for r in unseen])))
    assert np.mean(far.argmax(1) == [r[1] for r in unseen]) > 0.6


def test_one_class_and_no_rows(spark):
    one = boosting.fit(spark.createDataFrame([(1, 0, [1.0]), (2, 0, [2.0])], SCHEMA))
    assert one.rounds == [] and boosting.softmax(one.scores(one.binned(np.array([[5.0]])))).tolist() == [[1.0]]
    none = boosting.fit(spark.createDataFrame([], SCHEMA))
    assert boosting.probabilities(spark.createDataFrame([(1, 0, [1.0])], SCHEMA), none).first()["probability"] == []


def test_edges(spark):
    df = spark.createDataFrame([(i, 0, [float(i % 3), 7.0]) for i in range(30)], SCHEMA)
    assert [e.tolist() for e in boosting.quantile_edges(df, 255)] == [[0.0, 1.0], []]
