"""Small numeric kernels that run on arrays inside tasks."""

from __future__ import annotations

import numpy as np

#: Fixed value: the eight taps of the Daubechies wavelet with four vanishing moments (low pass, decomposition).
DB4 = np.array([-0.010597401785069032, 0.0328830116668852, 0.030841381835560764, -0.18703481171909309, -0.027983769416859854, 0.6308807679298589, 0.7148465705529157, 0.2303778133088965])
#: Its high pass.
DB4_HIGH = DB4[::-1] * np.where(np.arange(8) % 2, 1.0, -1.0)


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost, each row and column once.

    Shortest augmenting paths with potentials, row by row; equal costs go to the
    lower column.
    """
    n, m = cost.shape
    if n > m:
        return sorted((r, c) for c, r in assign(cost.T))
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, int)  # row (from 1) that has the column
    for row in range(1, n + 1):
        owner[0], at = row, 0
        best, back, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[at]:
            done[at] = True
            free = ~done[1:]
            reach = cost[owner[at] - 1] - u[owner[at]] - v[1:]
            nearer = free & (reach < best[1:])
            best[1:][nearer], back[1:][nearer] = reach[nearer], at
            nxt = int(np.where(free, best[1:], np.inf).argmin()) + 1
            step = best[nxt]
            u[owner[done]] += step
            v[done] -= step
            best[1:][free] -= step
            at = nxt
        while at:
            owner[at], at = owner[back[at]], back[at]
    return sorted((int(owner[c]) - 1, c - 1) for c in range(1, m + 1) if owner[c])


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Overlap of every box of a with every box of b; boxes are x, y, w, h."""
    a, b = a[:, None, :], b[None, :, :]
    wide = np.minimum(a[..., 0] + a[..., 2], b[..., 0] + b[..., 2]) - np.maximum(a[..., 0], b[..., 0])
    high = np.minimum(a[..., 1] + a[..., 3], b[..., 1] + b[..., 3]) - np.maximum(a[..., 1], b[..., 1])
    shared = np.maximum(wide, 0) * np.maximum(high, 0)
    union = a[..., 2] * a[..., 3] + b[..., 2] * b[..., 3] - shared
    return np.where(union > 0, shared / np.where(union > 0, union, 1), 0.0)


def ring(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull in order; of points on one line, its two ends."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def chain(rows) -> list:
        out: list = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(p.tolist()) + chain(p[::-1].tolist()))


def hull(points: np.ndarray) -> tuple[float, float]:
    """Area and perimeter of the convex hull; 0 and 0 if all points are on one line."""
    corners = ring(points)
    if len(corners) < 3:
        return 0.0, 0.0
    nxt = np.roll(corners, -1, axis=0)
    return float(abs((corners[:, 0] * nxt[:, 1] - nxt[:, 0] * corners[:, 1]).sum()) / 2), float(np.hypot(*(nxt - corners).T).sum())


def wavelet_energies(signal: np.ndarray, levels: int = 3) -> list[float]:
    """Energies [approximation, coarsest detail, ..., finest detail] of a db4 decomposition.

    The signal is padded by reflection to a power of two of 8 or more, and mirrored at
    both ends at each level.
    """
    n = 1 << max(3, int(np.ceil(np.log2(max(len(signal), 8)))))
    x = np.pad(signal, (0, n - len(signal)), mode="reflect") if len(signal) > 1 else np.full(n, signal[0])
    details = []
    for _ in range(levels):
        wide = np.pad(x, 7, mode="symmetric")
        low_pass, high_pass = (np.convolve(wide, taps, "valid")[1::2] for taps in (DB4, DB4_HIGH))
        details.insert(0, float((high_pass**2).sum()))
        x = low_pass
    return [float((x**2).sum()), *details]


def dilated(mask: np.ndarray) -> np.ndarray:
    """Every pixel with a set pixel among its 3 x 3 neighbours."""
    wide = np.pad(mask, 1)
    h, w = mask.shape
    return np.logical_or.reduce([wide[i : i + h, j : j + w] for i in range(3) for j in range(3)])


def eroded(mask: np.ndarray) -> np.ndarray:
    """Every pixel all of whose 3 x 3 neighbours are set; outside counts as not set."""
    wide = np.pad(mask, 1)
    h, w = mask.shape
    return np.logical_and.reduce([wide[i : i + h, j : j + w] for i in range(3) for j in range(3)])


def cleaned(mask: np.ndarray, close: int = 2, open_: int = 1) -> np.ndarray:
    """Binary closing, then opening."""
    for f, times in ((dilated, close), (eroded, close), (eroded, open_), (dilated, open_)):
        for _ in range(times):
            mask = f(mask)
    return mask


def boxes(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """x, y, w, h and pixels of each 8-connected region, by its first pixel in reading order.

    Labels spread by taking the least label around until nothing changes.
    """
    if not mask.any():
        return []
    h, w = mask.shape
    big = h * w
    label = np.where(mask, np.arange(big).reshape(h, w), big)
    while True:
        wide = np.pad(label, 1, constant_values=big)
        least = np.minimum.reduce([wide[i : i + h, j : j + w] for i in range(3) for j in range(3)])
        least = np.where(mask, least, big)
        root = np.append(least.ravel(), big)
        least = np.where(mask, np.minimum(least, root[least]), big)
        if (least == label).all():
            break
        label = least
    rows, cols = np.nonzero(mask)
    names, place = np.unique(label[mask], return_inverse=True)
    out = []
    for i in range(len(names)):
        r, c = rows[place == i], cols[place == i]
        out.append((int(c.min()), int(r.min()), int(np.ptp(c)) + 1, int(np.ptp(r)) + 1, len(r)))
    return out


def block_flow(before: np.ndarray, now: np.ndarray, block: int = 8, reach: int = 4) -> np.ndarray:
    """Rows x, y, dx, dy: where each block of the earlier frame is found again, by least absolute
    difference within ``reach`` pixels; of equals the shortest move."""
    h, w = before.shape
    moves = sorted(((dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)), key=lambda m: (m[0] ** 2 + m[1] ** 2, m))
    wide = np.pad(now.astype(np.int32), reach, mode="edge")
    rows, cols = h // block, w // block
    cost = []
    for dy, dx in moves:
        d = np.abs(wide[reach + dy : reach + dy + h, reach + dx : reach + dx + w] - before)[: rows * block, : cols * block]
        cost.append(d.reshape(rows, block, cols, block).sum((1, 3)))
    best = np.argmin(np.stack(cost), axis=0)
    y, x = np.mgrid[0:rows, 0:cols] * block + block // 2
    dy, dx = np.array(moves)[best].transpose(2, 0, 1)
    return np.stack([x.ravel(), y.ravel(), dx.ravel(), dy.ravel()], axis=1)
