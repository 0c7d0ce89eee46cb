"""Joint deep kernels: gradients against finite differences, and a bound above that of two stages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nestfold.models import gp, joint, net, tuned
from nestfold.operators import scale
from nestfold.plans import nested
from nestfold.sources.storage import materialize
from nestfold.queries import QUERIES


@pytest.fixture(scope="module")
def curve(spark):
    df = spark.range(240).select("id", ((F.col("id") * 37 % 240) / 240).alias("a"), ((F.col("id") * 61 % 240) / 240).alias("b"))
    return materialize(df.select("id", F.array("a", "b").alias("features"), (F.sin(9 * F.col("a")) * 0.4 + F.col("b") * 0.1).alias("y")).repartition(3), "curve")


def covariance(kind):
    rng = np.random.default_rng(3)
    if kind == "spectral":
        return gp.Covariance(kind, mixture=(np.array([0.6, 0.5]), rng.normal(size=(2, 2)), np.abs(rng.normal(size=(2, 2))) + 0.2))
    return gp.Covariance(kind, np.array([0.4, 0.9]))


@pytest.mark.parametrize("kind", ["rbf", "matern0.5", "matern1.5", "matern2.5", "spectral"])
def test_derivatives_by_rows_equal_finite_differences(kind):
    rng = np.random.default_rng(1)
    f, z, g, cov = rng.normal(size=(5, 2)), rng.normal(size=(4, 2)), rng.normal(size=(5, 4)), covariance(kind)
    got = joint.by_rows(cov, f, z, g)
    for i in np.ndindex(f.shape):
        step = np.zeros(f.shape)
        step[i] = 1e-6
        assert got[i] == pytest.approx(((g * cov(f + step, z)).sum() - (g * cov(f - step, z)).sum()) / 2e-6, rel=1e-4, abs=1e-6)


@pytest.mark.parametrize("kind", ["matern1.5", "spectral"])
def test_gradient_equals_finite_differences(curve, kind):
    extractor = joint.Extractor(net.Net((2, 6, 2), head="mse"))
    params, mean = extractor.shape.init(5), gp.LinearMean(0.1)
    at = tuned.Point(covariance(kind), np.random.default_rng(2).normal(size=(5, 2)), 0.5, 0.05)
    _, needed = joint.bound(curve, extractor, params, at, mean)
    got, n = joint.gradient(curve, extractor, params, at, mean, needed), len(params)
    assert len(got) == n + len(at.vector())
    for i in [0, 7, n - 3, n - 1, n, n + 1, len(got) - 3, len(got) - 2, len(got) - 1]:
        step = np.zeros(len(got))
        step[i] = 1e-5
        up, down = (joint.bound(curve, extractor, params + s[:n], at.at(at.vector() + s[n:], 0), mean)[0] for s in (step, -step))
        assert got[i] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-4)
    with pytest.raises(ValueError, match="constant mean"):
        joint.gradient(curve, extractor, params, at, gp.LinearMean(0.0, np.ones(2)), needed)


def test_scaled_extractor_and_a_bound_above_two_stages(curve):
    fitted = net.pretrain_extractor(curve, 2, 12, 3, 2, epochs=3)
    learned = materialize(fitted.transform(curve, ["id", "y"]), "learned")
    edges = scale.array_bounds(learned, "features").collect()[0]
    lo, hi = np.array(edges.lo), np.array(edges.hi)
    extractor, params = joint.extractor_of(fitted, lo, hi)
    got = {r.id: r.features for r in joint._features(curve, extractor, params, ["id"], "features").collect()}
    for r in learned.collect():
        assert np.allclose(got[r.id], (np.array(r.features) - lo) / np.where(hi > lo, hi - lo, 1))
    inside = materialize(joint._features(curve, extractor, params, ["id", "y"], "features"), "inside")
    start = gp.fit(inside, gp.random_points(inside, ["id"], 10), gp.candidate_kernels("rbf", gp.feature_spread(inside)), gp.fit_mean(inside))
    model, bounds = joint.fit(curve, extractor, params, start, steps=20)
    assert bounds[0] == pytest.approx(start.bound, rel=1e-5) and all(b > a for a, b in zip(bounds, bounds[1:]))
    assert bounds[-1] > start.bound + 5 and model.gp.bound == pytest.approx(bounds[-1], rel=1e-5)
    error = F.avg((F.col("pred_mean") - F.col("y")) ** 2).alias("mse")
    scored = model.predict(curve, ["id", "y"]).agg(error, F.min("pred_var").alias("v")).collect()[0]
    staged = start.predict(inside, ["id", "y"]).agg(error).collect()[0]
    assert scored.mse < 0.9 * staged.mse and scored.v > 0


def test_joint_query_raises_the_bound_on_parts(spark, sf):
    got = QUERIES["joint_deep_kernel"](spark, sf).orderBy("step").collect()
    assert len(got) > 2 and all(b.bound > a.bound for a, b in zip(got, got[1:]))
    assert nested.FAMILIES["VDKL"].fit is nested.fit_deep_kernel
