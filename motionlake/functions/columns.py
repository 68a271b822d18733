"""Column expressions that several operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TAU = 2 * math.pi


def distance(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def wrapped(turn: Column) -> Column:
    """The smaller of the two angles between two directions, in 0 to pi."""
    return F.least(F.abs(turn), F.lit(TAU) - F.abs(turn))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is not above 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def iou(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    """Intersection over union of two boxes; 0 for an empty union."""
    wide = F.greatest(F.least(ax + aw, bx + bw) - F.greatest(ax, bx), F.lit(0))
    high = F.greatest(F.least(ay + ah, by + bh) - F.greatest(ay, by), F.lit(0))
    union = aw * ah + bw * bh - wide * high
    return F.when(union > 0, wide * high / union).otherwise(F.lit(0.0))


def rounded(c: str | Column, digits: int = 6) -> Column:
    """Rounded for results that are compared across engines; -0.0 becomes 0.0."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def bin_of(v: Column, low: float, high: float, n: int) -> Column:
    """Bin 0 to n - 1 of a value in low to high; the last bin is closed."""
    return F.least(F.floor((v - low) / ((high - low) / n)), F.lit(n - 1))
