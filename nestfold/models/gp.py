"""Sparse Gaussian process regression from one pass of sufficient statistics.

The collapsed bound of Titsias (2009) needs only sums over the rows: of k k',
of k y, of y^2 and their number. Noise and output scale are then fitted on the
driver from these m x m sums, and several length scales share the same pass.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from typing import Sequence

import numpy as np
from pyspark.ml.regression import LinearRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from nestfold.functions.kernels import kernel_matrix, spectral_mixture_matrix
from nestfold.functions.keys import order_hash
from nestfold.models.passes import append_columns, batches_of, sum_over_rows
from nestfold.operators.split import sample_exact

MAX_POINTS = 2000  # an m x m matrix of doubles is 32 MB then
JITTER = 1e-6
NOISE_FLOOR = 1e-4  # for targets scaled to 0..1, as the studies scale them


def random_points(df: DataFrame, key: Sequence[str], m: int, features: str = "features", seed: int = 73) -> np.ndarray:
    """m rows without replacement, in hash order."""
    if m > MAX_POINTS:
        raise ValueError(f"at most {MAX_POINTS} inducing points")
    rows = sample_exact(df, key, m, seed).select(order_hash(seed, *key).alias("h"), features).collect()
    return np.array([r[features] for r in sorted(rows, key=lambda r: r.h)], dtype=np.float64)


def lloyd_step(df: DataFrame, centres: np.ndarray, features: str = "features") -> tuple[np.ndarray, np.ndarray]:
    """Rows go to their nearest centre; returns the mean of each centre's rows and their number.

    A centre without rows stays where it is.
    """
    bc = df.sparkSession.sparkContext.broadcast(centres)
    m, dim = centres.shape

    def task(stream):
        total = np.zeros((m, dim + 1))
        for x, _ in batches_of(stream, features):
            c = bc.value
            near = ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)
            np.add.at(total, near, np.hstack([x, np.ones((len(x), 1))]))
        return total.ravel()

    total = sum_over_rows(df, [features], task, m * (dim + 1), bc).reshape(m, dim + 1)
    n = total[:, -1]
    means = np.where(n[:, None] > 0, total[:, :-1] / np.maximum(n, 1)[:, None], centres)
    return means, n


def kmeans_points(df: DataFrame, key: Sequence[str], m: int, steps: int = 10, features: str = "features", seed: int = 73) -> np.ndarray:
    centres = random_points(df, key, m, features, seed)
    for _ in range(steps):
        moved, _ = lloyd_step(df, centres, features)
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


@dataclass
class LinearMean:
    """Mean function: a constant, plus slopes if it is linear."""

    intercept: float
    slopes: np.ndarray | None = None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.intercept + (0 if self.slopes is None else x @ self.slopes)


def fit_mean(df: DataFrame, kind: str = "constant", features: str = "features", target: str = "y") -> LinearMean:
    if kind == "constant":
        return LinearMean(df.agg(F.avg(target)).collect()[0][0])
    if kind != "linear":
        raise ValueError(f"unknown mean {kind}")
    rows = df.select(array_to_vector(F.col(features).cast("array<double>")).alias("x"), F.col(target).cast("double").alias("t"))
    model = LinearRegression(featuresCol="x", labelCol="t", solver="normal").fit(rows)
    return LinearMean(model.intercept, np.array(model.coefficients.toArray()))


@dataclass
class Covariance:
    """Kernel kind with its shape parameters; output scale is separate."""

    kind: str
    lengthscales: np.ndarray | None = None
    mixture: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def __call__(self, x: np.ndarray, points: np.ndarray) -> np.ndarray:
        if self.kind == "spectral":
            return spectral_mixture_matrix(x, points, *self.mixture)
        return kernel_matrix(self.kind, x, points, self.lengthscales)

    @property
    def diagonal(self) -> float:
        return float(self.mixture[0].sum()) if self.kind == "spectral" else 1.0


def statistics(df: DataFrame, points: np.ndarray, kernels: Sequence[Covariance], mean: LinearMean, features: str = "features", target: str = "y"):
    """For each kernel (sum k k', sum k y), and (sum y^2, n): one pass for all."""
    m = len(points)
    upper = np.triu_indices(m)
    tri = len(upper[0])
    width = tri + m
    bc = df.sparkSession.sparkContext.broadcast((points, list(kernels), mean))

    def task(stream):
        z, covs, mu = bc.value
        grams = [np.zeros((m, m)) for _ in covs]
        cross = [np.zeros(m) for _ in covs]
        tail = np.zeros(2)
        for x, y in batches_of(stream, features, target):
            e = y - mu(x)
            tail += (e @ e, len(x))
            for i, cov in enumerate(covs):
                k = cov(x, z)
                grams[i] += k.T @ k
                cross[i] += k.T @ e
        return np.concatenate([*[np.append(a[upper], b) for a, b in zip(grams, cross)], tail])

    total = sum_over_rows(df, [features, target], task, len(kernels) * width + 2, bc)
    out = []
    for i in range(len(kernels)):
        part = total[i * width:(i + 1) * width]
        gram = np.zeros((m, m))
        gram[upper] = part[:tri]
        gram = gram + np.triu(gram, 1).T
        out.append((gram, part[tri:]))
    return out, float(total[-2]), float(total[-1])


@dataclass
class SparseGP:
    points: np.ndarray
    covariance: Covariance
    mean: LinearMean
    outputscale: float
    noise: float
    bound: float
    alpha: np.ndarray = field(repr=False, default=None)
    shrink: np.ndarray = field(repr=False, default=None)
    seconds: float = 0.0

    def predict_arrays(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = self.outputscale * self.covariance(x, self.points)
        prior = self.outputscale * self.covariance.diagonal
        latent = prior - np.einsum("ij,ij->i", k @ self.shrink, k)
        return self.mean(x) + k @ self.alpha, np.maximum(latent, 0) + self.noise

    def predict(self, df: DataFrame, keep: Sequence[str], features: str = "features") -> DataFrame:
        bc = df.sparkSession.sparkContext.broadcast(self)

        def compute(x: np.ndarray) -> dict[str, np.ndarray]:
            mean, var = bc.value.predict_arrays(x)
            return {"pred_mean": mean, "pred_var": var}

        return append_columns(df, features, keep, compute, "pred_mean double, pred_var double")

    def score_rows(self, df: DataFrame, keep: Sequence[str], features: str = "features", target: str = "y") -> DataFrame:
        """Mean, variance and log density of the target, in Arrow batches."""
        from nestfold.functions.metrics import log_marginal

        scored = self.predict(df, [*dict.fromkeys([*keep, target])], features)
        return scored.withColumn("log_density", log_marginal(F.col("pred_mean"), F.col(target), F.col("pred_var")))


def collapsed_bound(lam: np.ndarray, gamma2: np.ndarray, yy: float, n: float, diag: float, outputscale: float, noise: float) -> float:
    """The bound from the eigenvalues of L^-1 (sum k k') L^-T and rotated L^-1 sum k y."""
    b = 1 + outputscale * lam / noise
    return float(
        -0.5 * n * np.log(2 * np.pi * noise) - 0.5 * np.log(b).sum() - 0.5 * yy / noise
        + 0.5 * outputscale / noise ** 2 * (gamma2 / b).sum()
        - 0.5 * outputscale * (n * diag - lam.sum()) / noise
    )


def _best_scales(lam, gamma2, yy, n, diag, noise_floor) -> tuple[float, float, float]:
    """Output scale and noise with the highest bound: a grid, refined around its best cell."""
    spread = max(yy / n, noise_floor)
    centre, width = np.array([0.0, -3.0]), 8.0
    best, at = (-np.inf, spread, spread), centre
    for _ in range(12):
        for a in np.linspace(-width, width, 9):
            for b in np.linspace(-width, width, 9):
                s, t = centre[0] + a, centre[1] + b
                if not -16 < t < 6 or not -16 < s < 12:
                    continue
                scale, noise = spread * np.exp(s), max(spread * np.exp(t), noise_floor)
                value = collapsed_bound(lam, gamma2, yy, n, diag, scale, noise)
                if value > best[0]:
                    best, at = (value, scale, noise), np.array([s, t])
        centre, width = at, width / 2
    return best


def fit(
    df: DataFrame, points: np.ndarray, kernels: Sequence[Covariance], mean: LinearMean,
    features: str = "features", target: str = "y", fixed: tuple[float, float] | None = None,
    noise_floor: float = NOISE_FLOOR,
) -> SparseGP:
    """The kernel, output scale and noise with the highest bound.

    ``fixed`` = (output scale, noise) leaves these as they are.
    """
    began = time.time()
    stats, yy, n = statistics(df, points, kernels, mean, features, target)
    best: SparseGP | None = None
    for cov, (gram, cross) in zip(kernels, stats):
        kmm = cov(points, points) + JITTER * np.eye(len(points))
        low = np.linalg.cholesky(kmm)
        half = np.linalg.solve(low, gram)
        inner = np.linalg.solve(low, half.T)
        lam, rot = np.linalg.eigh((inner + inner.T) / 2)
        lam = np.maximum(lam, 0)
        beta = np.linalg.solve(low, cross)
        gamma2 = (rot.T @ beta) ** 2
        if fixed is None:
            bound, scale, noise = _best_scales(lam, gamma2, yy, n, cov.diagonal, noise_floor)
        else:
            scale, noise = fixed
            bound = collapsed_bound(lam, gamma2, yy, n, cov.diagonal, scale, noise)
        if best is None or bound > best.bound:
            # S = Kmm + A/noise = scale * L R (I + scale*lam/noise) R' L'
            back = np.linalg.solve(low.T, rot)
            b = 1 + scale * lam / noise
            s_inverse = (back / b) @ back.T / scale
            k_inverse = back @ back.T / scale
            best = SparseGP(points, cov, mean, scale, noise, bound, s_inverse @ (scale * cross) / noise, k_inverse - s_inverse)
    best.seconds = time.time() - began
    return best


def candidate_kernels(kind: str, spread: np.ndarray, factors: Sequence[float] = (0.25, 0.5, 1.0, 2.0, 4.0)) -> list[Covariance]:
    """One length scale per dimension, times each factor; all evaluated in one pass."""
    spread = np.where(spread > 0, spread, 1.0)
    return [Covariance(kind, spread * f) for f in factors]


def spectral_kernels(spread: np.ndarray, n_mixtures: int, seed: int = 73, draws: int = 3) -> list[Covariance]:
    """Random spectral mixtures whose frequencies match the spread of the inputs."""
    rng = np.random.default_rng(seed)
    spread = np.where(spread > 0, spread, 1.0)
    out = []
    for _ in range(draws):
        means = np.abs(rng.normal(size=(n_mixtures, len(spread)))) / (4 * spread)
        scales = np.abs(rng.normal(size=(n_mixtures, len(spread)))) / (4 * spread)
        out.append(Covariance("spectral", mixture=(np.full(n_mixtures, 1 / n_mixtures), means, scales)))
    return out


def feature_spread(df: DataFrame, features: str = "features") -> np.ndarray:
    """Standard deviation of each element of the feature array, from one pass."""
    rows = df.select(F.posexplode(features).alias("dim", "x")).groupBy("dim").agg(F.stddev_pop(F.col("x").cast("double")).alias("s")).collect()
    return np.array([r.s for r in sorted(rows, key=lambda r: r.dim)])
