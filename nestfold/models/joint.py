"""Deep kernels trained jointly: network, kernel and inducing points follow one gradient.

The bound is that of ``gp``, over the features the network computes. The second
pass of ``tuned`` goes on through the network: a row's derivative by its
features is taken back through the layers, and the weights' derivatives are
summed beside those of the kernel and the inducing points. Both passes are sums over rows;
the driver holds parameters only. A row's features are recomputed in each pass, so nothing is written.

Steps are quasi-Newton, and are taken only if the bound rises. The features'
scale into (0, 1) is fixed at the start and is part of the network from then on, as a last linear layer.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from typing import Sequence

import numpy as np
from pyspark.sql import DataFrame

from nestfold.models import gp, net, tuned
from nestfold.models.passes import append_columns, batches_of, sum_over_rows


@dataclass(frozen=True)
class Extractor:
    """A ReLU network with a linear last layer; its parameters are one flat vector."""

    shape: net.Net

    def features(self, params: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.shape.outputs(params, x)[-1]

    def pull_back(self, params: np.ndarray, x: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Derivative of sum(d * features) by the parameters."""
        acts, layers, out = self.shape.outputs(params, x), self.shape.layers(params), []
        for i in range(len(layers) - 1, -1, -1):
            out[:0] = [(acts[i].T @ d).ravel(), d.sum(0)]
            if i:
                d = (d @ layers[i][0].T) * (acts[i] > 0)
        return np.concatenate(out)


def extractor_of(fitted: net.Fitted, lo: np.ndarray, hi: np.ndarray) -> tuple[Extractor, np.ndarray]:
    """A pretrained extractor without its output on top, its features scaled from (lo, hi) to (0, 1)."""
    shape = net.Net(fitted.net.sizes[:-1], head="mse")
    params = fitted.members[0][:shape.n_params].copy()
    w, b = shape.layers(params)[-1]  # views: the last layer takes the scale
    span = np.where(hi > lo, hi - lo, 1.0)
    w /= span
    b -= lo
    b /= span
    return Extractor(shape), params


def by_rows(cov: gp.Covariance, f: np.ndarray, z: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Derivative of sum(g * cov(f, z)) by f: kernels depend on differences, so the roles may be swapped."""
    return tuned.pull_back(cov, z, f, g.T)[1]


@dataclass
class DeepKernel:
    """A network and the sparse GP on its features."""

    extractor: Extractor
    params: np.ndarray
    gp: gp.SparseGP

    def transform(self, df: DataFrame, keep: Sequence[str], features: str = "features") -> DataFrame:
        return _features(df, self.extractor, self.params, keep, features)

    def predict(self, df: DataFrame, keep: Sequence[str], features: str = "features") -> DataFrame:
        return self.gp.predict(self.transform(df, keep, features), keep)


def _features(df: DataFrame, extractor: Extractor, params: np.ndarray, keep: Sequence[str], features: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(params)
    return append_columns(df, features, keep, lambda x: {"features": extractor.features(shared.value, x)}, "features array<double>")


def bound(df: DataFrame, extractor: Extractor, params: np.ndarray, at: tuned.Point, mean: gp.LinearMean, features: str = "features", target: str = "y"):
    """The bound, and what ``gradient`` needs of it: one pass."""
    return tuned.bound(_features(df, extractor, params, [target], features), at, mean, "features", target)


def gradient(df: DataFrame, extractor: Extractor, params: np.ndarray, at: tuned.Point, mean: gp.LinearMean, needed,
             features: str = "features", target: str = "y") -> np.ndarray:
    """Derivatives of the bound by the network's parameters, then by the point's vector: one pass.

    The mean function must be a constant; a linear one would have to follow the features.
    """
    if mean.slopes is not None:
        raise ValueError("joint training takes a constant mean")
    (by_a, by_b, by_k, by_s, by_v), n = needed
    n_shape = len(at.vector()) - at.points.size - 2
    size = len(params) + n_shape + at.points.size
    shared = df.sparkSession.sparkContext.broadcast((params, at.covariance, at.points, mean, by_a, by_b))

    def task(stream):
        own, cov, z, mu, two, one = shared.value
        total = np.zeros(size)
        for x, y in batches_of(stream, features, target):
            for start in range(0, len(x), 2048):
                some, e = x[start:start + 2048], y[start:start + 2048]
                f = extractor.features(own, some)
                g = 2 * cov(f, z) @ two + np.outer(e - mu(f), one)
                shape, by_z = tuned.pull_back(cov, f, z, g)
                total += np.concatenate([extractor.pull_back(own, some, by_rows(cov, f, z, g)), shape, by_z.ravel()])
        return total

    rows = sum_over_rows(df, [features, target], task, size, shared)
    network, shape, by_z = np.split(rows, [len(params), len(params) + n_shape])
    own_shape, own_z = tuned.pull_back(at.covariance, at.points, at.points, by_k)
    shape = shape + own_shape
    if at.covariance.kind == "spectral":
        q = len(at.covariance.mixture[0])
        shape[:q] -= 0.5 * n * at.scale / at.noise * at.covariance.mixture[0]
    return np.concatenate([network, shape, by_z + 2 * own_z.ravel(), [by_s, by_v]])


def fit(df: DataFrame, extractor: Extractor, params: np.ndarray, start: gp.SparseGP, steps: int = 20, features: str = "features",
        target: str = "y", noise_floor: float = gp.NOISE_FLOOR, least_gain: float = 1e-4) -> tuple[DeepKernel, list[float]]:
    """Train all parameters from the two-stage model ``start``; also the bound after each step taken.

    ``df`` holds the network's inputs. Ends after ``steps``, when a step gains
    less than ``least_gain``, or when no step in the direction raises the bound.
    """
    began, mean = time.time(), start.mean
    at, weights = tuned.Point(start.covariance, start.points, start.outputscale, start.noise), params
    value, needed = bound(df, extractor, weights, at, mean, features, target)
    g, bounds, past = gradient(df, extractor, weights, at, mean, needed, features, target), [value], []
    for _ in range(steps):
        way = tuned._direction(g, past)
        if way @ g <= 0:
            way, past = g.copy(), []
        length = min(1.0, (2.0 if past else 0.1) / np.abs(way).max())
        for _ in range(tuned.HALVINGS):
            moved = weights + length * way[:len(params)]
            there = at.at(at.vector() + length * way[len(params):], noise_floor)
            new, needed = bound(df, extractor, moved, there, mean, features, target)
            if new > value + 1e-4 * length * (way @ g):
                break
            length /= 2
        else:
            break
        new_g = gradient(df, extractor, moved, there, mean, needed, features, target)
        step = np.concatenate([moved - weights, there.vector() - at.vector()])
        change = g - new_g
        if step @ change > 1e-12:
            past = [*past, (step, change)][-tuned.MEMORY:]
        gain, weights, at, value, g = new - value, moved, there, new, new_g
        bounds.append(value)
        if gain < least_gain:
            break
    made = gp.fit(_features(df, extractor, weights, [target], features), at.points, [at.covariance], mean, "features", target, fixed=(at.scale, at.noise))
    made.seconds = start.seconds + time.time() - began
    return DeepKernel(extractor, weights, made), bounds
