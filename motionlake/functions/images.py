"""Image kernels on single gray frames; borders are reflected without repeating the edge."""

from __future__ import annotations

import numpy as np


def resized(frame: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, with pixel centres aligned."""
    h, w = frame.shape
    if (h, w) == (height, width):
        return frame
    y, x = ((np.arange(n) + 0.5) * m / n - 0.5 for n, m in ((height, h), (width, w)))
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    y0, x0 = np.minimum(y.astype(int), max(h - 2, 0)), np.minimum(x.astype(int), max(w - 2, 0))
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    f = frame.astype(float)
    top = f[np.ix_(y0, x0)] * (1 - fx) + f[np.ix_(y0, x1)] * fx
    low = f[np.ix_(y1, x0)] * (1 - fx) + f[np.ix_(y1, x1)] * fx
    return np.clip(np.rint(top * (1 - fy) + low * fy), 0, 255).astype(np.uint8)


def spread(frame: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """A separable filter with the same odd taps down and across."""
    r, out = len(taps) // 2, frame.astype(float)
    for axis in (0, 1):
        wide = np.pad(out, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="reflect" if out.shape[axis] > r else "edge")
        out = sum(t * np.take(wide, range(i, i + out.shape[axis]), axis) for i, t in enumerate(taps))
    return out


def gaussian(frame: np.ndarray, size: int = 5, sigma: float | None = None) -> np.ndarray:
    """Gaussian blur; without a sigma it follows from the size."""
    sigma = sigma or 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    taps = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
    return spread(frame, taps / taps.sum())


def to_bytes(frame: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(frame), 0, 255).astype(np.uint8)


def laplacian_variance(frame: np.ndarray) -> float:
    wide = np.pad(frame.astype(float), 1, mode="reflect" if min(frame.shape) > 1 else "edge")
    return float((wide[:-2, 1:-1] + wide[2:, 1:-1] + wide[1:-1, :-2] + wide[1:-1, 2:] - 4 * wide[1:-1, 1:-1]).var())


def gradients(frame: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sobel gradients across and down."""
    w = np.pad(frame.astype(float), 1, mode="reflect" if min(frame.shape) > 1 else "edge")
    across, down = w[:, 2:] - w[:, :-2], w[2:] - w[:-2]
    return across[:-2] + 2 * across[1:-1] + across[2:], down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]


def gamma(frame: np.ndarray, value: float = 1.5) -> np.ndarray:
    return (((np.arange(256) / 255.0) ** (1 / value)) * 255).astype(np.uint8)[frame]


def unsharp(frame: np.ndarray, strength: float = 1.5, sigma: float = 2.0) -> np.ndarray:
    """Sharpened by strength (1 + tanh(Laplacian variance / 100)) times what a blur takes away."""
    k = strength * (1 + np.tanh(laplacian_variance(frame) / 100))
    size = 2 * int(3 * sigma + 0.5) + 1
    return to_bytes(frame * (1 + k) - k * gaussian(frame, size, sigma))


def wiener(frame: np.ndarray) -> np.ndarray:
    """5 x 5 adaptive smoothing: what stands out of a pixel's surroundings is kept in proportion to how much
    of their variance is not noise; noise is the mean of the variances below their 20 % point, or 100."""
    f, box = frame.astype(float), np.full(5, 0.2)
    around = spread(f, box)
    variance = spread(f * f, box) - around**2
    quiet = variance[variance < np.percentile(variance, 20)]
    noise = quiet.mean() if quiet.size else 100.0
    signal = np.clip(1 - noise / np.maximum(variance, max(noise, 1e-12)), 0, 1)
    return np.clip(around + signal * (f - around), 0, 255).astype(np.uint8)


def stretched(frame: np.ndarray) -> np.ndarray:
    """Rescaled so that the least and greatest value are the 2 and 98 % points."""
    low, high = np.percentile(frame, (2, 98))
    f = frame.astype(float)
    span = f.max() - f.min()
    return to_bytes(low + (f - f.min()) * (high - low) / span) if span else frame


def equalised(frame: np.ndarray, tiles: int = 8, limit: float = 2.0) -> np.ndarray:
    """Local histogram equalisation with clipped contrast, one mapping per tile, mixed between tiles."""
    h, w = frame.shape
    th, tw = max(1, -(-h // tiles)), max(1, -(-w // tiles))
    rows, cols = -(-h // th), -(-w // tw)
    maps = np.zeros((rows, cols, 256))
    for i in range(rows):
        for j in range(cols):
            part = frame[i * th : (i + 1) * th, j * tw : (j + 1) * tw]
            n = np.bincount(part.ravel(), minlength=256).astype(float)
            most = max(1.0, limit * part.size / 256)
            n = np.minimum(n, most) + np.maximum(n - most, 0).sum() / 256
            maps[i, j] = np.cumsum(n) * 255 / part.size
    y, x = np.clip((np.arange(h) + 0.5) / th - 0.5, 0, rows - 1), np.clip((np.arange(w) + 0.5) / tw - 0.5, 0, cols - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, rows - 1), np.minimum(x0 + 1, cols - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    at = lambda a, b: maps[a[:, None], b[None, :], frame]
    return to_bytes((at(y0, x0) * (1 - fx) + at(y0, x1) * fx) * (1 - fy) + (at(y1, x0) * (1 - fx) + at(y1, x1) * fx) * fy)


def bilateral(frame: np.ndarray, radius: int = 2, value: float = 75.0, space: float = 75.0) -> np.ndarray:
    """Edge-keeping smoothing: neighbours weigh by nearness in place and in value."""
    f = frame.astype(float)
    wide = np.pad(f, radius, mode="reflect" if min(f.shape) > radius else "edge")
    total, mass = np.zeros_like(f), np.zeros_like(f)
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            g = wide[radius + dy : radius + dy + f.shape[0], radius + dx : radius + dx + f.shape[1]]
            w = np.exp(-(dy * dy + dx * dx) / (2 * space * space) - (g - f) ** 2 / (2 * value * value))
            total, mass = total + w * g, mass + w
    return to_bytes(total / mass)


def orientation9(patch: np.ndarray) -> np.ndarray:
    """Nine magnitude-weighted gradient directions, unit length (zeros for a flat patch)."""
    gx, gy = gradients(patch)
    n, _ = np.histogram(np.arctan2(gy, gx) % (2 * np.pi), bins=9, range=(0, 2 * np.pi), weights=np.hypot(gx, gy))
    return n / (np.linalg.norm(n) + 1e-7)


def strong_corners(frame: np.ndarray, most: int = 100, quality: float = 0.01, apart: int = 5) -> list[tuple[int, int]]:
    """x, y of pixels whose 3 x 3 gradients change strongly in both directions (the lesser eigenvalue of
    their moments): local maxima over ``quality`` of the strongest, in falling order, ``apart`` pixels or more."""
    gx, gy = gradients(frame)
    box = np.ones(3)
    xx, yy, xy = spread(gx * gx, box), spread(gy * gy, box), spread(gx * gy, box)
    strength = (xx + yy) / 2 - np.sqrt(((xx - yy) / 2) ** 2 + xy * xy)
    wide = np.pad(strength, 1, constant_values=-np.inf)
    h, w = frame.shape
    peak = strength >= np.max([wide[i : i + h, j : j + w] for i in range(3) for j in range(3)], axis=0)
    rows, cols = np.nonzero(peak & (strength > max(quality * strength.max(), 1e-9)))
    kept: list[tuple[int, int]] = []
    for i in np.argsort(-strength[rows, cols], kind="stable").tolist():
        x, y = int(cols[i]), int(rows[i])
        if all((x - a) ** 2 + (y - b) ** 2 >= apart * apart for a, b in kept):
            kept.append((x, y))
            if len(kept) == most:
                break
    return kept


def ring_corners(frame: np.ndarray, threshold: int = 20, run: int = 9) -> list[tuple[int, int]]:
    """x, y in reading order of pixels with ``run`` neighbours in a row, on the ring of radius 3, that are all
    brighter or all darker by more than ``threshold``."""
    h, w = frame.shape
    if min(h, w) < 7:
        return []
    turn = np.arange(16) * np.pi / 8
    dx, dy = np.rint(3 * np.cos(turn)).astype(int), np.rint(3 * np.sin(turn)).astype(int)
    f = frame.astype(int)
    ring = np.stack([f[3 + b : h - 3 + b, 3 + a : w - 3 + a] for a, b in zip(dx, dy, strict=True)]) - f[3 : h - 3, 3 : w - 3]
    hit = np.zeros(ring.shape[1:], bool)
    for side in (ring > threshold, ring < -threshold):
        round_ = np.concatenate([side, side[: run - 1]])
        hit |= np.lib.stride_tricks.sliding_window_view(round_, run, axis=0).all(-1).any(0)
    rows, cols = np.nonzero(hit)
    return [(int(c) + 3, int(r) + 3) for r, c in zip(rows, cols, strict=True)]
