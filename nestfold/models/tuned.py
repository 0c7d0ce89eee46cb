"""Sparse GPs whose kernel and inducing points follow the gradient of the collapsed bound.

One pass sums what the bound needs (``gp.statistics``). The bound's derivatives by
these sums are two small matrices; a second pass takes them back to the rows and
sums the derivatives by length scales, spectral weights, means and scales, and
inducing points. A quasi-Newton step follows; a step is taken only if the bound rises.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from nestfold.models import gp
from nestfold.models.passes import batches_of, sum_over_rows

MEMORY = 10  # steps a quasi-Newton direction remembers
HALVINGS = 12  # of a step that does not raise the bound


@dataclass
class Point:
    """Where the search is: kernel, inducing points, output scale and noise, as one vector and back."""

    covariance: gp.Covariance
    points: np.ndarray
    scale: float
    noise: float

    def vector(self) -> np.ndarray:
        c = self.covariance
        if c.kind == "spectral":
            w, means, scales = c.mixture
            shape = [np.log(w), means.ravel(), np.log(scales).ravel()]
        else:
            shape = [np.log(c.lengthscales)]
        return np.concatenate([*shape, self.points.ravel(), [np.log(self.scale), np.log(self.noise)]])

    def at(self, v: np.ndarray, noise_floor: float) -> Point:
        c, n_points = self.covariance, self.points.size
        shape, z, tail = v[:-n_points - 2], v[-n_points - 2:-2], v[-2:]
        if c.kind == "spectral":
            q, d = c.mixture[1].shape
            cov = gp.Covariance("spectral", mixture=(np.exp(shape[:q]), shape[q:q + q * d].reshape(q, d), np.exp(shape[q + q * d:]).reshape(q, d)))
        else:
            cov = gp.Covariance(c.kind, np.exp(shape))
        return Point(cov, z.reshape(self.points.shape), float(np.exp(tail[0])), max(float(np.exp(tail[1])), noise_floor))


def _slope(kind: str, r: np.ndarray) -> np.ndarray:
    """Minus the derivative of the kernel's profile by r, over r."""
    if kind == "rbf":
        return np.exp(-0.5 * r * r)
    if kind == "matern0.5":
        return np.divide(np.exp(-r), r, out=np.zeros_like(r), where=r > 1e-9)
    if kind == "matern1.5":
        return 3 * np.exp(-np.sqrt(3) * r)
    return 5 / 3 * (1 + np.sqrt(5) * r) * np.exp(-np.sqrt(5) * r)


def pull_back(cov: gp.Covariance, x: np.ndarray, z: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of sum(g * cov(x, z)) by the kernel's vector and by z."""
    if cov.kind != "spectral":
        scales = cov.lengthscales
        a, b = x / scales, z / scales
        r = np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))
        w = g * _slope(cov.kind, r)
        rows, columns = w.sum(1), w.sum(0)
        by_scale = rows @ (a * a) - 2 * (a * (w @ b)).sum(0) + columns @ (b * b)
        return by_scale, (w.T @ a - columns[:, None] * b) / scales
    weights, means, widths = cov.mixture
    q, d = means.shape
    by_weight, by_mean, by_width, by_z = np.zeros(q), np.zeros((q, d)), np.zeros((q, d)), np.zeros(z.shape)
    t = x[:, None, :] - z[None, :, :]
    for i in range(q):
        fall = np.exp(-2 * (np.pi * t * widths[i]) ** 2)
        turn = 2 * np.pi * t * means[i]
        factors = fall * np.cos(turn)
        one = np.ones(factors.shape[:2] + (1,))
        others = np.concatenate([one, np.cumprod(factors, axis=2)[..., :-1]], axis=2) * np.concatenate(
            [np.cumprod(factors[..., ::-1], axis=2)[..., ::-1][..., 1:], one], axis=2)
        part = weights[i] * g[..., None] * others
        by_weight[i] = weights[i] * (g * factors.prod(axis=2)).sum()
        by_mean[i] = (part * fall * -np.sin(turn) * 2 * np.pi * t).sum(axis=(0, 1))
        by_width[i] = (part * factors * -4 * (np.pi * t * widths[i]) ** 2).sum(axis=(0, 1))
        by_z -= (part * (factors * -4 * np.pi ** 2 * t * widths[i] ** 2 - fall * np.sin(turn) * 2 * np.pi * means[i])).sum(axis=0)
    return np.concatenate([by_weight, by_mean.ravel(), by_width.ravel()]), by_z


def _value(at: Point, gram, cross, yy: float, n: float):
    """The bound at a point, and its derivatives by the sums, the inducing points' kernel, scale and noise."""
    s, v = at.scale, at.noise
    kuu = at.covariance(at.points, at.points) + gp.JITTER * np.eye(len(at.points))
    k, a, b = s * kuu, s * s * gram, s * cross
    sigma = k + a / v
    try:
        low_k, low_s = np.linalg.cholesky(k), np.linalg.cholesky(sigma)
    except np.linalg.LinAlgError:
        return -np.inf, None
    inverse = lambda low: (lambda i: i.T @ i)(np.linalg.solve(low, np.eye(len(low))))
    k_inv, s_inv = inverse(low_k), inverse(low_s)
    u = s_inv @ b
    free = n * s * at.covariance.diagonal - (k_inv * a).sum()
    value = (-0.5 * (n * np.log(2 * np.pi * v) + 2 * np.log(np.diag(low_s)).sum() - 2 * np.log(np.diag(low_k)).sum()
                     + yy / v - b @ u / v ** 2) - 0.5 * free / v)
    by_a = -0.5 * s_inv / v - 0.5 * np.outer(u, u) / v ** 3 + 0.5 * k_inv / v
    by_k = -0.5 * s_inv + 0.5 * k_inv - 0.5 * np.outer(u, u) / v ** 2 - 0.5 * k_inv @ a @ k_inv / v
    by_b = u / v ** 2
    by_s = 2 * s * (by_a * gram).sum() + by_b @ cross + (by_k * kuu).sum() - 0.5 * n * at.covariance.diagonal / v
    by_v = (-0.5 * n / v + 0.5 * (s_inv * a).sum() / v ** 2 + 0.5 * yy / v ** 2 - b @ u / v ** 3
            + 0.5 * u @ a @ u / v ** 4 + 0.5 * free / v ** 2)
    return float(value), (s * s * by_a, s * by_b, s * by_k, s * by_s, v * by_v)


def bound(df: DataFrame, at: Point, mean: gp.LinearMean, features: str = "features", target: str = "y"):
    """The bound at a point, and what ``gradient`` needs of it."""
    [(gram, cross)], yy, n = gp.statistics(df, at.points, [at.covariance], mean, features, target)
    value, parts = _value(at, gram, cross, yy, n)
    return value, (parts, n)


def gradient(df: DataFrame, at: Point, mean: gp.LinearMean, needed, features: str = "features", target: str = "y") -> np.ndarray:
    """The derivatives of the bound by the point's vector: one more pass."""
    (by_a, by_b, by_k, by_s, by_v), n = needed
    n_shape = len(at.vector()) - at.points.size - 2
    shared = df.sparkSession.sparkContext.broadcast((at.covariance, at.points, mean, by_a, by_b))

    def task(stream):
        cov, z, mu, two, one = shared.value
        total = np.zeros(n_shape + z.size)
        for x, y in batches_of(stream, features, target):
            for start in range(0, len(x), 2048):  # a spectral kernel holds rows x points x dimensions at once
                some, e = x[start:start + 2048], y[start:start + 2048]
                shape, by_z = pull_back(cov, some, z, 2 * cov(some, z) @ two + np.outer(e - mu(some), one))
                total += np.concatenate([shape, by_z.ravel()])
        return total

    rows = sum_over_rows(df, [features, target], task, n_shape + at.points.size, shared)
    shape, by_z = pull_back(at.covariance, at.points, at.points, by_k)
    out = np.concatenate([rows[:n_shape] + shape, rows[n_shape:] + 2 * by_z.ravel(), [by_s, by_v]])
    if at.covariance.kind == "spectral":
        q = len(at.covariance.mixture[0])
        out[:q] -= 0.5 * n * at.scale / at.noise * at.covariance.mixture[0]
    return out


def _direction(g: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The quasi-Newton direction uphill from the last steps and changes of the gradient (Nocedal, 1980)."""
    out, kept = g.copy(), []
    for step, change in reversed(past):
        a = (step @ out) / (step @ change)
        kept.append(a)
        out -= a * change
    if past:
        step, change = past[-1]
        out *= (step @ change) / (change @ change)
    for (step, change), a in zip(past, reversed(kept)):
        out += step * (a - (change @ out) / (step @ change))
    return out


def fit(df: DataFrame, start: gp.SparseGP, steps: int = 20, features: str = "features", target: str = "y",
        noise_floor: float = gp.NOISE_FLOOR, least_gain: float = 1e-4) -> tuple[gp.SparseGP, list[float]]:
    """``start`` with tuned parameters, and the bound after each step taken.

    Ends after ``steps``, or when a step gains less than ``least_gain``, or when
    no step in the direction raises the bound.
    """
    began = time.time()
    at = Point(start.covariance, start.points, start.outputscale, start.noise)
    value, needed = bound(df, at, start.mean, features, target)
    g, bounds, past = gradient(df, at, start.mean, needed, features, target), [value], []
    for _ in range(steps):
        way = _direction(g, past)
        if way @ g <= 0:
            way, past = g.copy(), []
        length = min(1.0, 0.5 / np.abs(way).max()) if not past else min(1.0, 2.0 / np.abs(way).max())
        for _ in range(HALVINGS):
            there = at.at(at.vector() + length * way, noise_floor)
            new, needed = bound(df, there, start.mean, features, target)
            if new > value + 1e-4 * length * (way @ g):
                break
            length /= 2
        else:
            break
        new_g = gradient(df, there, start.mean, needed, features, target)
        step, change = there.vector() - at.vector(), g - new_g
        if step @ change > 1e-12:
            past = [*past, (step, change)][-MEMORY:]
        gain, at, value, g = new - value, there, new, new_g
        bounds.append(value)
        if gain < least_gain:
            break
    made = gp.fit(df, at.points, [at.covariance], start.mean, features, target, fixed=(at.scale, at.noise))
    made.seconds = start.seconds + time.time() - began
    return made, bounds
