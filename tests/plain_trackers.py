"""The trackers told plainly, one track at a time, for small inputs."""

from __future__ import annotations

import itertools
import math

import numpy as np


def iou(a, b):
    wide = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    high = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    both = max(wide, 0) * max(high, 0)
    union = a[2] * a[3] + b[2] * b[3] - both
    return both / union if union > 0 else 0.0


def centre(b):
    return b[0] + b[2] // 2, b[1] + b[3] // 2


def best_pairs(score):
    """Pairs (row, column) of the assignment of greatest total, over all of them."""
    n, m = len(score), len(score[0])
    if n <= m:
        options = ([*zip(range(n), c, strict=True)] for c in itertools.permutations(range(m), n))
    else:
        options = ([*zip(r, range(m), strict=True)] for r in itertools.permutations(range(n), m))
    return max(options, key=lambda pairs: sum(score[r][c] for r, c in pairs))


class Kalman:
    def __init__(self, b):
        self.x = np.array([*self.seen(b), 0, 0, 0], float)
        self.p = np.diag([10.0] * 7)
        self.f = np.eye(7)
        for i in range(3):
            self.f[i, i + 4] = 1
        self.h = np.eye(4, 7)

    @staticmethod
    def seen(b):
        return b[0] + b[2] / 2, b[1] + b[3] / 2, b[2] * b[3], b[2] / b[3] if b[3] > 0 else 1.0

    def predict(self, last):
        self.x = self.f @ self.x
        self.p = self.f @ self.p @ self.f.T + np.diag([0.03] * 4 + [0.0003] * 3)
        if self.x[2] <= 0 or self.x[3] <= 0:
            return last
        w = math.sqrt(self.x[2] * self.x[3])
        h = self.x[2] / w
        return [math.trunc(v) for v in (self.x[0] - w / 2, self.x[1] - h / 2, w, h)]

    def correct(self, b):
        s = self.h @ self.p @ self.h.T + np.diag([0.3, 0.3, 0.03, 0.03])
        k = self.p @ self.h.T @ np.linalg.inv(s)
        self.x = self.x + k @ (np.array(self.seen(b)) - self.h @ self.x)
        self.p = (np.eye(7) - k @ self.h) @ self.p


def run(kind, frames, gap=30, above=0.3, eta=0.5, lam=1e-4, rate=0.02, scales=(1.0,)):
    """frames: frame number -> list of (box, looks by scale). Returns rows (frame, place in frame, track, hits)."""
    tracks, out, fresh = [], [], 0
    for no in range(min(frames), max(frames) + 1):
        here = frames.get(no, [])
        for t in tracks:
            t["expected"] = t["kalman"].predict(t["box"]) if kind == "sort" else t["box"]
        pairs = []
        if tracks and here:
            if kind == "centroid":
                order = sorted((math.dist(centre(t["box"]), centre(b)), i, j) for i, t in enumerate(tracks) for j, (b, _) in enumerate(here))
                rows, cols = set(), set()
                for _, i, j in order:
                    if i not in rows and j not in cols:
                        pairs.append((i, j))
                        rows.add(i)
                        cols.add(j)
            else:
                share = [[iou(t["expected"], b) for b, _ in here] for t in tracks]
                pairs = [(i, j) for i, j in best_pairs(share) if share[i][j] > above]
        names = {}
        for t in tracks:
            t["missed"] += 1
        for i, j in pairs:
            t, (b, looks) = tracks[i], here[j]
            kept = b
            if kind == "tfcr":
                w = t["weights"]
                answers = [float(w @ looks[s]) for s in scales]
                scale = scales[answers.index(max(answers))]
                if scale != 1:
                    size = max(4, math.trunc(b[2] * scale)), max(4, math.trunc(b[3] * scale))
                    c = centre(b)
                    kept = [max(0, c[0] - size[0] // 2), max(0, c[1] - size[1] // 2), *size]
                p = looks[1.0]
                slope = 2 * ((1 - eta) * float(w @ p) - 1) * p + 2 * lam * w
                t["weights"] = w - rate * (0.5 + 0.5 * iou(t["box"], b)) * slope
            if kind == "sort":
                t["kalman"].correct(b)
            t.update(box=kept, missed=0, hits=t["hits"] + 1)
            names[j] = t
        for j, (b, looks) in enumerate(here):
            if j not in names:
                names[j] = {"id": fresh, "box": b, "missed": 0, "hits": 1, "kalman": Kalman(b) if kind == "sort" else None, "weights": np.random.default_rng(fresh).standard_normal(9) * 0.01}
                tracks.append(names[j])
                fresh += 1
            out.append((no, j, names[j]["id"], names[j]["hits"]))
        tracks = [t for t in tracks if t["missed"] <= gap]
    return out
