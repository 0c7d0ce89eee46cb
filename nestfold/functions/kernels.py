"""Covariance functions, as column expressions and for arrays inside tasks."""

from __future__ import annotations

import math
from typing import Callable, Sequence

import numpy as np
from pyspark.sql import Column, functions as F

# Each profile maps a scaled distance r to a correlation.
_PROFILES: dict[str, Callable] = {
    "rbf": lambda r, exp: exp(-0.5 * r * r),
    "matern0.5": lambda r, exp: exp(-1.0 * r),
    "matern1.5": lambda r, exp: (1 + math.sqrt(3) * r) * exp(-math.sqrt(3) * r),
    "matern2.5": lambda r, exp: (1 + math.sqrt(5) * r + 5 / 3 * r * r) * exp(-math.sqrt(5) * r),
}
KERNELS = tuple(_PROFILES)


def kernel_column(kind: str, x: Column, point: Sequence[float], lengthscales: Sequence[float], outputscale: float = 1.0) -> Column:
    """Covariance of an array column with one fixed point."""
    centre, scale = F.lit([float(p) for p in point]), F.lit([float(s) for s in lengthscales])
    diff = F.zip_with(F.zip_with(x, centre, lambda a, b: a.cast("double") - b), scale, lambda d, s: d / s)
    r = F.sqrt(F.reduce(diff, F.lit(0.0), lambda total, d: total + d * d))
    return outputscale * _PROFILES[kind](r, F.exp)


def kernel_matrix(kind: str, x: np.ndarray, points: np.ndarray, lengthscales: np.ndarray, outputscale: float = 1.0) -> np.ndarray:
    """Covariances of rows with points."""
    a, b = x / lengthscales, points / lengthscales
    squared = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return outputscale * _PROFILES[kind](np.sqrt(np.maximum(squared, 0)), np.exp)


def spectral_mixture_matrix(x: np.ndarray, points: np.ndarray, weights: np.ndarray, means: np.ndarray, scales: np.ndarray) -> np.ndarray:
    """Sum over q of w_q prod_d exp(-2 pi^2 t^2 s^2) cos(2 pi t m), t = x - point (Wilson and Adams, 2013)."""
    total = np.zeros((len(x), len(points)))
    for w, m, s in zip(weights, means, scales):
        term = np.full_like(total, w)
        for k in range(x.shape[1]):
            t = x[:, k][:, None] - points[:, k][None, :]
            term *= np.exp(-2 * (np.pi * t * s[k]) ** 2) * np.cos(2 * np.pi * t * m[k])
        total += term
    return total
