import numpy as np
import pytest
from pyspark.sql import functions as F

from nestfold.functions.kernels import KERNELS, kernel_column, kernel_matrix
from nestfold.functions.metrics import mse
from nestfold.models import gp, net, store
from nestfold.operators import mixture
from nestfold.operators.encode import assemble
from nestfold.plans import nested
from nestfold.sources import results, storage
from nestfold.sources.storage import materialize


@pytest.fixture(scope="module")
def curve(spark):
    """A smooth target of two features, 800 rows in 4 partitions."""
    df = spark.range(800).select(
        "id", ((F.col("id") * 37 % 800) / 800).alias("a"), ((F.col("id") * 61 % 800) / 800).alias("b"))
    df = df.withColumn("y", F.sin(6 * F.col("a")) * 0.4 + F.col("b") * 0.3)
    return materialize(assemble(df, ["a", "b"], keep=["id", "a", "b", "y"]).repartition(4, "id"), "curve")


@pytest.fixture(scope="module")
def arrays(curve):
    rows = curve.orderBy("id").collect()
    return np.array([r.features for r in rows], dtype=float), np.array([r.y for r in rows])


def test_layer_widths_taper():
    assert net.layer_widths(3, 100, 4, 2) == [3, 100, 67, 35, 2]
    assert [net.pretrain_epochs(n) for n in (9_999, 10_000, 100_000)] == [25, 10, 5]


@pytest.mark.parametrize("head,out", [("gaussian", 2), ("mse", 1)])
def test_gradient_matches_finite_differences(head, out):
    rng = np.random.default_rng(0)
    shape = net.Net((3, 5, 4, out), head)
    x, y, p = rng.normal(size=(11, 3)), rng.normal(size=11), shape.init(1)
    _, g = shape.loss_and_gradient(p, x, y)
    for i in range(0, shape.n_params, 3):
        step = np.zeros_like(p)
        step[i] = 1e-6
        slope = (shape.loss_and_gradient(p + step, x, y)[0] - shape.loss_and_gradient(p - step, x, y)[0]) / 2e-6
        assert g[i] == pytest.approx(slope, rel=1e-4, abs=1e-5)


def test_gradient_pass_equals_local_sum(curve, arrays):
    shape = net.mean_variance_net(2, 8, 3)
    p = shape.init(3)
    states = np.concatenate([p, np.zeros(2 * len(p))])[None]
    g, loss = net._gradient_pass(curve, shape, states, [0], "features", "y")
    want, grad = shape.loss_and_gradient(p, *arrays)
    assert loss[0] == pytest.approx(want / 800) and np.allclose(g[0], grad / 800)


def test_block_sums_equal_direct_sums(curve, monkeypatch):
    from nestfold.models import passes

    direct = gp.statistics(curve, np.random.default_rng(1).random((120, 2)), [gp.Covariance("rbf", np.ones(2))], gp.LinearMean(0.0))
    monkeypatch.setattr(passes, "DIRECT", 0)
    blocks = gp.statistics(curve, np.random.default_rng(1).random((120, 2)), [gp.Covariance("rbf", np.ones(2))], gp.LinearMean(0.0))
    assert np.allclose(direct[0][0][0], blocks[0][0][0]) and np.allclose(direct[0][0][1], blocks[0][0][1]) and direct[1:] == pytest.approx(blocks[1:])


@pytest.mark.parametrize("sync,epochs", [("average", 25), ("gradient", 60)])
def test_networks_beat_the_mean(curve, sync, epochs):
    fitted = net.fit(curve, net.mean_variance_net(2, 16, 3), n_members=2, lr=0.01, epochs=epochs, batch_size=128, sync=sync)
    got = fitted.predict(curve, ["id", "y"]).agg(mse(F.col("pred_mean"), F.col("y")).alias("m"), F.var_pop("y").alias("v"), F.min("pred_var").alias("p")).collect()[0]
    assert got.m < 0.5 * got.v and got.p > 0


def test_members_mixed_in_the_task_equal_the_mixture_operator(curve):
    fitted = net.fit(curve, net.mean_variance_net(2, 6, 2), n_members=3, epochs=1)
    a = {r.id: r for r in fitted.predict(curve, ["id"]).collect()}
    for r in mixture.equal_mixture(fitted.components(curve, ["id"]), ["id"]).collect():
        assert r.pred_mean == pytest.approx(a[r.id].pred_mean) and r.pred_var == pytest.approx(a[r.id].pred_var, abs=1e-9)


def test_members_stop_by_themselves(curve):
    fitted = net.fit(curve, net.mean_variance_net(2, 6, 2), n_members=2, lr=2.0, epochs=12, patience=1, validation=curve)
    assert all(1 <= len(losses) <= 12 for losses in fitted.losses)
    assert any(len(losses) < 12 for losses in fitted.losses)


@pytest.mark.parametrize("kind", KERNELS)
def test_kernel_columns_equal_matrices(curve, arrays, kind):
    point, scales = [0.3, 0.7], [0.2, 0.5]
    got = [r.k for r in curve.orderBy("id").select(kernel_column(kind, F.col("features"), point, scales, 1.7).alias("k")).collect()]
    assert np.allclose(got, kernel_matrix(kind, arrays[0], np.array([point]), np.array(scales), 1.7)[:, 0], atol=1e-7)


def test_all_points_give_the_exact_process(spark, curve, arrays):
    few = materialize(curve.filter("id % 16 = 0"), "few")
    rows = few.orderBy("id").collect()
    x, y = np.array([r.features for r in rows], dtype=float), np.array([r.y for r in rows])
    scale, noise = 0.3, 0.01
    cov = gp.Covariance("matern1.5", np.array([0.4, 0.6]))
    model = gp.fit(few, x, [cov], gp.LinearMean(0.1), fixed=(scale, noise))
    k = scale * cov(x, x)
    full = k + noise * np.eye(len(x))
    at = arrays[0][:50]
    cross = scale * cov(at, x)
    mean, var = model.predict_arrays(at)
    assert np.allclose(mean, 0.1 + cross @ np.linalg.solve(full, y - 0.1), atol=1e-3)
    assert np.allclose(var, scale - np.einsum("ij,ji->i", cross, np.linalg.solve(full, cross.T)) + noise, atol=1e-3)
    e = y - 0.1
    exact = -0.5 * (e @ np.linalg.solve(full, e) + np.linalg.slogdet(full)[1] + len(y) * np.log(2 * np.pi))
    assert model.bound == pytest.approx(exact, abs=0.05)


@pytest.mark.parametrize("kind", ["rbf", "spectral"])
def test_sparse_process_beats_the_mean(curve, kind):
    spread = gp.feature_spread(curve)
    kernels = gp.spectral_kernels(spread, 3) if kind == "spectral" else gp.candidate_kernels(kind, spread)
    model = gp.fit(curve, gp.random_points(curve, ["id"], 30), kernels, gp.fit_mean(curve))
    got = model.predict(curve, ["id", "y"]).agg(mse(F.col("pred_mean"), F.col("y")).alias("m"), F.var_pop("y").alias("v")).collect()[0]
    assert got.m < 0.3 * got.v


def test_lloyd_keeps_empty_centres(curve):
    centres = np.array([[0.2, 0.2], [0.8, 0.8], [50.0, 50.0]])
    moved, n = gp.lloyd_step(curve, centres)
    assert n.sum() == 800 and n[2] == 0 and np.allclose(moved[2], centres[2])


def test_models_survive_storage(spark, curve):
    fitted = net.fit(curve, net.mean_variance_net(2, 6, 2), n_members=2, epochs=1)
    path = storage.fresh_path(spark, "net")
    store.save_net(spark, path, fitted)
    again = store.load_net(spark, path)
    assert again.net == fitted.net and np.array_equal(again.members, fitted.members)


@pytest.fixture(scope="module")
def study(curve):
    return nested.prepare(curve.select("id", "a", "b", "y"), ["id"], ["a", "b"], "curve")


@pytest.mark.parametrize("model,params", [
    ("RF", {"n_estimators": 10, "max_depth": 6, "max_features": "auto"}),
    ("XGB", {"n_estimators": 15, "max_depth": 4, "learning_rate": 0.3}),
    ("DE", {"n_max": 16, "n_layers": 3, "lr": 0.01, "batch_size": 64, "epochs": 15, "n_members": 2}),
    ("SGP", {"num_inducing": 30, "kernel_type": "rbf"}),
    ("VDKL", {"n_max": 16, "n_layers": 3, "n_out": 2, "mean_type": "linear", "kernel_type": "matern1.5", "num_inducing": 30, "lr": 0.01, "batch_size": 32, "epochs": 25}),
])
def test_outer_runs_beat_the_mean(study, curve, model, params):
    rows, predictions = nested.evaluate(study, model, {run: params for run in (1, 2)})
    variance = curve.agg(F.var_pop("y")).collect()[0][0]
    got = rows.orderBy("outer_run").collect()
    assert [r.outer_run for r in got] == [1, 2] and all(r.mse < 0.6 * variance for r in got)
    assert (got[0].nll_score is None) == (model in ("RF", "XGB"))
    assert predictions.count() == 320


def test_search_logs_failures_and_goes_on(study):
    configs = [{"n_estimators": 3, "max_depth": 3, "max_features": "auto"}, {"n_estimators": 3, "max_depth": 3, "max_features": "nonsense"}]
    log = {r.number: r for r in nested.search(study, "RF", 1, configs).collect()}
    assert log[0].state == "COMPLETE" and log[1].state == "FAIL" and log[1].value is None
    assert nested.best_trial(nested.search(study, "RF", 1, configs[:1]), by=("outer_cv_split",)).count() == 1


def test_nested_study_and_reevaluation(spark, study):
    configs = [{"n_estimators": 2, "max_depth": 2, "max_features": "auto"}, {"n_estimators": 5, "max_depth": 5, "max_features": "auto"}]
    log, rows = nested.nested_study(study, "RF", configs, holdout_above=0)
    assert log.count() == 10 and rows.count() == 5
    path = storage.fresh_path(spark, "results")
    results.append_log(rows, path)
    again = nested.reevaluate(study, "RF", results.read_log(spark, path))
    both = again.join(rows.select("outer_run", F.col("mse").alias("m")), "outer_run").collect()
    assert len(both) == 5 and all(r.run_kind == "reevaluated" and r.mse == pytest.approx(r.m) for r in both)
