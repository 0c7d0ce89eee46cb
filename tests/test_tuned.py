"""Tuned kernels: gradients against finite differences, a bound that never falls, and better bounds than fixed candidates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nestfold.models import gp, tuned
from nestfold.sources.storage import materialize

KINDS = ("rbf", "matern0.5", "matern1.5", "matern2.5", "spectral")


@pytest.fixture(scope="module")
def curve(spark):
    df = spark.range(240).select("id", ((F.col("id") * 37 % 240) / 240).alias("a"), ((F.col("id") * 61 % 240) / 240).alias("b"))
    return materialize(df.select("id", F.array("a", "b").alias("features"), (F.sin(9 * F.col("a")) * 0.4 + F.col("b") * 0.1).alias("y")).repartition(3), "curve")


def covariance(kind):
    rng = np.random.default_rng(3)
    if kind == "spectral":
        return gp.Covariance(kind, mixture=(np.array([0.6, 0.5]), rng.normal(size=(2, 2)), np.abs(rng.normal(size=(2, 2))) + 0.2))
    return gp.Covariance(kind, np.array([0.4, 0.9]))


@pytest.mark.parametrize("kind", KINDS)
def test_pull_back_equals_finite_differences(kind):
    rng = np.random.default_rng(1)
    x, z, g = rng.normal(size=(7, 2)), rng.normal(size=(4, 2)), rng.normal(size=(7, 4))
    at = tuned.Point(covariance(kind), z, 1.0, 1.0)
    shape, by_z = tuned.pull_back(at.covariance, x, z, g)
    got, v = np.concatenate([shape, by_z.ravel()]), at.vector()
    for i in range(len(v) - 2):
        step = np.zeros(len(v))
        step[i] = 1e-6
        up, down = at.at(v + step, 0), at.at(v - step, 0)
        slope = ((g * up.covariance(x, up.points)).sum() - (g * down.covariance(x, down.points)).sum()) / 2e-6
        assert got[i] == pytest.approx(slope, rel=1e-4, abs=1e-6)


@pytest.mark.parametrize("kind", ["rbf", "spectral"])
def test_gradient_of_the_bound_equals_finite_differences(curve, kind):
    mean = gp.LinearMean(0.1)
    at = tuned.Point(covariance(kind), gp.random_points(curve, ["id"], 5), 0.5, 0.05)
    value, needed = tuned.bound(curve, at, mean)
    got, v = tuned.gradient(curve, at, mean, needed), at.vector()
    fixed = gp.fit(curve, at.points, [at.covariance], mean, fixed=(at.scale, at.noise))
    assert value == pytest.approx(fixed.bound, rel=1e-9)
    for i in [0, 1, len(v) // 2, len(v) - 3, len(v) - 2, len(v) - 1]:
        step = np.zeros(len(v))
        step[i] = 1e-5
        slope = (tuned.bound(curve, at.at(v + step, 0), mean)[0] - tuned.bound(curve, at.at(v - step, 0), mean)[0]) / 2e-5
        assert got[i] == pytest.approx(slope, rel=1e-3, abs=1e-4)


@pytest.mark.parametrize("kind", ["rbf", "matern1.5", "spectral"])
def test_bound_rises_above_the_candidates(curve, kind):
    spread = gp.feature_spread(curve)
    kernels = gp.spectral_kernels(spread, 2) if kind == "spectral" else gp.candidate_kernels(kind, spread)
    start = gp.fit(curve, gp.random_points(curve, ["id"], 12), kernels, gp.fit_mean(curve))
    model, bounds = tuned.fit(curve, start, steps=6)
    assert bounds[0] == pytest.approx(start.bound, rel=1e-6) and all(b > a for a, b in zip(bounds, bounds[1:]))
    assert bounds[-1] > start.bound + 5 and model.bound == pytest.approx(bounds[-1], rel=1e-6)
    if kind == "rbf":  # the target turns along one dimension only
        assert model.covariance.lengthscales[1] > 2 * model.covariance.lengthscales[0]
