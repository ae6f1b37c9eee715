"""Decreasing functions between distances and fuzzy weights, and their inverses."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

Pair = tuple[Callable[[Column], Column], Callable[[Column], Column]]


def erf(x: np.ndarray) -> np.ndarray:
    """Error function, by a series of terms of one sign: exp(-x x) * sum of 2 ** n * x ** (2 n + 1) / (2 n + 1)!!; error below 1e-14."""
    x = np.asarray(x, float)
    a = np.minimum(np.abs(x), 6.0)
    term = total = a
    for n in range(1, 120):
        term = term * (2 * a * a / (2 * n + 1))
        total = total + term
    return np.sign(x) * np.minimum(2 / math.sqrt(math.pi) * np.exp(-a * a) * total, 1.0)


def erf_inverse(y: np.ndarray) -> np.ndarray:
    """Inverse error function: a logarithmic first guess, refined by Newton steps."""
    y = np.clip(np.asarray(y, float), -1, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.log(np.maximum(1 - y * y, 1e-300))
        a = 2 / (math.pi * 0.147) + t / 2
        x = np.sign(y) * np.sqrt(np.maximum(np.sqrt(a * a - t / 0.147) - a, 0))
        for _ in range(3):
            x = np.where(np.abs(y) < 1, x - (erf(x) - y) * np.exp(np.minimum(x * x, 700)) * math.sqrt(math.pi) / 2, x)
    return np.where(y >= 1, np.inf, np.where(y <= -1, -np.inf, x))


@F.pandas_udf(DoubleType())
def _erf(x: pd.Series) -> pd.Series:
    return pd.Series(erf(x.to_numpy()))


@F.pandas_udf(DoubleType())
def _erf_inverse(x: pd.Series) -> pd.Series:
    return pd.Series(erf_inverse(x.to_numpy()))


def phi(name: str | Pair | None = None, scale: float = 1.0, shape: float = 2.0) -> Pair:
    """(phi, inverse) by name: exp (default), half_normal, log_normal, pareto, uniform, identity; or a pair of functions of columns."""
    if name is None:
        name = "exp"
    if not isinstance(name, str):
        if len(name) != 2 or not all(callable(f) for f in name):
            raise TypeError("phi needs both a function and its inverse")
        return name
    root2 = math.sqrt(2)
    known: dict[str, Pair] = {
        "exp": (lambda d: F.exp(-d / scale), lambda w: -F.log(w) * scale),
        "half_normal": (lambda d: 1 - _erf(d / (root2 * scale)), lambda w: _erf_inverse(1 - w) * (root2 * scale)),
        "log_normal": (lambda d: F.when(d <= 0, 1.0).otherwise((1 - _erf(F.log(F.greatest(d, F.lit(1e-300))) / (root2 * scale))) / 2), lambda w: F.exp(_erf_inverse(1 - 2 * w) * (root2 * scale))),
        "pareto": (lambda d: F.pow(1 + d / scale, -shape), lambda w: (F.pow(w, -1 / shape) - 1) * scale),
        "uniform": (lambda d: 1 - F.least(d / scale, F.lit(1.0)), lambda w: (1 - F.least(w, F.lit(1.0))) * scale),
        "identity": (lambda d: d, lambda w: w),
    }
    if name not in known:
        raise ValueError(f"unknown phi {name!r}; known: {', '.join(known)}")
    return known[name]
