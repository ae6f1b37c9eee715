"""Vector arithmetic on array columns, in doubles."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b))


def circular_distance(a: Column, b: Column) -> Column:
    """Signed difference of two angles, in (-pi, pi]."""
    return F.atan2(F.sin(a - b), F.cos(a - b))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def rounded(x: np.ndarray, to: int) -> np.ndarray:
    """What Spark's round() makes of doubles, halves away from zero by their decimal digits, and without negative zeros. Where a product cannot tell the side of a half, digits do."""
    ten = 10.0**to
    with np.errstate(all="ignore"):
        wide = np.abs(x) * ten
        low = np.floor(wide)
        part = wide - low
        out = np.copysign((low + (part >= 0.5)) / ten, x) + 0.0
        part -= 0.5
        unsure = np.flatnonzero((~(np.abs(part) > 1e-6) | ~(wide < 1e9)) & np.isfinite(x))
    for k in unsure.tolist():
        out[k] = float(Decimal(repr(float(x[k]))).quantize(Decimal(1).scaleb(-to), ROUND_HALF_UP)) + 0.0 if abs(x[k]) < 1e15 else x[k]
    return out
