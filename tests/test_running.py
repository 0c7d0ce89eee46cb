"""The running search: its rules against the replay operators, restart, and the trial log."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from nestfold.models import net
from nestfold.operators import trials as replay
from nestfold.plans import nested, running
from nestfold.sources import storage
from nestfold.sources.storage import materialize

CONFIGS = [{"lr": lr, "n_max": n, "n_layers": layers, "batch_size": 64} for lr, n, layers in (
    (0.01, 8, 2), (0.2, 8, 3), (1e-5, 4, 2), (0.003, 16, 3), (0.05, 6, 2), (1.0, 8, 2))]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(400).select("id", ((F.col("id") * 37 % 400) / 400).alias("a"), ((F.col("id") * 61 % 400) / 400).alias("b"))
    df = df.select("id", F.array("a", "b").alias("features"), (F.sin(6 * F.col("a")) * 0.4 + F.col("b") * 0.3).alias("t"), (F.col("id") % 3 + 1).alias("fold"))
    return materialize(df.repartition(3, "id"), "rows")


def learners(config, fold, members=2):
    shape = net.mean_variance_net(2, config["n_max"], config["n_layers"])
    return [net.Learner.fresh(shape, config["lr"], config["batch_size"], fold, 7 + i) for i in range(members)]


def search(rows, rules, path, configs=CONFIGS, **more):
    return running.run(rows, [1, 2, 3], configs, learners, rules, path, **more)


def told(trials):
    return [(t.number, t.state, t.values, t.losses, t.best) for t in trials]


def test_one_epoch_equals_training_each_learner_alone(rows):
    made = [learners(c, f, 1)[0] for c, f in ((CONFIGS[0], 1), (CONFIGS[3], 2), (CONFIGS[0], 9))]
    net.epoch_of(rows, made, 0)
    for one, (c, f) in zip(made, ((CONFIGS[0], 1), (CONFIGS[3], 2), (CONFIGS[0], 9))):
        alone = learners(c, f, 1)
        net.epoch_of(rows, alone, 0)
        assert np.allclose(alone[0].state, one.state) and alone[0].steps == one.steps
    # A fold left out has no part in the training: other targets there change nothing.
    other = materialize(rows.withColumn("t", F.when(F.col("fold") == 1, 99.0).otherwise(F.col("t"))), "other")
    again = learners(CONFIGS[0], 1, 1)
    net.epoch_of(other, again, 0)
    assert np.allclose(again[0].state, made[0].state)


def test_score_is_the_ensembles_mean_on_the_fold(rows):
    ensemble = learners(CONFIGS[0], 2)
    got = net.fold_errors(rows, [ensemble])[0]
    part = rows.filter("fold = 2").collect()
    x, y = np.array([r.features for r in part]), np.array([r.t for r in part])
    mean = np.mean([m.net.predict(m.weights, x)[0] for m in ensemble], axis=0)
    assert got == pytest.approx(((mean - y) ** 2).mean())


def test_patience_equals_the_replay(spark, rows):
    path = storage.fresh_path(spark, "search")
    rules = running.Rules(epochs=9, patience=2, at_once=6)
    trials = search(rows, rules, path)
    log = running.reports(spark, path)
    assert log.count() == sum(len(t.values) for t in trials)
    stops = {r.number: r for r in replay.early_stopping(log, rules.patience).collect()}
    for t in trials:
        assert t.state == "COMPLETE" and t.best == pytest.approx(stops[t.number].best_value)
        assert stops[t.number].stop_pos == (None if t.step == 8 and t.stopper.bad < 2 else t.step)
        assert t.max_epochs(rules) == (9 if t.step == 8 else max(1, t.step - 1))
    assert any(t.step < 8 for t in trials)


def test_time_equals_the_replay(spark, rows):
    path, ticks = storage.fresh_path(spark, "search"), itertools.count()
    rules = running.Rules(epochs=30, patience=50, tolerance=4.0, at_once=1)
    trials = search(rows, rules, path, CONFIGS[:2], clock=lambda: float(next(ticks)))
    got = {r.number: r for r in replay.time_budget(running.reports(spark, path), 4.0).collect()}
    assert [t.step for t in trials] == [4, 4] == [got[t.number].stop_step for t in trials]
    assert all(t.best == pytest.approx(got[t.number].best_value) for t in trials)


def test_hyperband_equals_the_replay(spark, rows):
    path = storage.fresh_path(spark, "search")
    rules = running.Rules(epochs=9, patience=50, pruner="hyperband", min_resource=1, factor=3, at_once=9)
    configs = [{**c, "lr": c["lr"] / (1 + i // 6)} for i, c in enumerate(CONFIGS * 2)]
    trials = search(rows, rules, path, configs)
    got = {r.number: r for r in replay.hyperband(running.reports(spark, path), 1, 9, 3).collect()}
    for t in trials:
        assert (t.step if t.state == "PRUNED" else None) == got[t.number].dropped_step
    assert {t.state for t in trials} == {"PRUNED", "COMPLETE"}


def test_median_rule_equals_the_replay(spark, rows):
    path = storage.fresh_path(spark, "search")
    rules = running.Rules(epochs=6, patience=50, pruner="median", startup=2, warmup=1, interval=2)
    trials = search(rows, rules, path)
    log = spark.createDataFrame([("search", t.number, t.state) for t in trials], "study string, number int, state string")
    reports = running.reports(spark, path).withColumn("number", F.col("number").cast("int"))
    got = {r.number: r.pruned_step for r in replay.median_pruning(reports, log, 2, 1, 2).collect()}
    for t in trials:
        assert (t.step if t.state == "PRUNED" else None) == got.get(t.number)
    assert any(t.state == "PRUNED" for t in trials)


@pytest.mark.parametrize("pruner,save_every", [(None, 1), ("hyperband", 2)])
def test_a_killed_search_goes_on(spark, rows, pruner, save_every):
    rules = running.Rules(epochs=9, patience=3, pruner=pruner, at_once=3, save_every=save_every)
    whole = search(rows, rules, storage.fresh_path(spark, "search"))
    path = storage.fresh_path(spark, "search")

    def killed(round_):
        if round_ in (3, 7):
            raise KeyboardInterrupt

    calls = 0
    while True:
        calls += 1
        try:
            again = search(rows, rules, path, after_round=killed if calls < 3 else None)
            break
        except KeyboardInterrupt:
            pass
    assert calls > 1 and told(again) == told(whole)
    assert told(search(rows, rules, path)) == told(whole)  # a finished search trains nothing
    assert running.reports(spark, path).count() == sum(len(t.values) for t in whole)


def test_nan_ends_a_trial(spark, rows):
    bad = materialize(rows.withColumn("t", F.lit(float("nan"))), "bad")
    trials = search(bad, running.Rules(epochs=4), storage.fresh_path(spark, "search"), CONFIGS[:1])
    assert [(t.state, t.step, t.best) for t in trials] == [("FAIL", 0, None)]


def test_trial_log_of_networks_and_boosting(spark, rows):
    df = rows.select("id", F.col("features")[0].alias("a"), F.col("features")[1].alias("b"), F.col("t").alias("y"))
    study = nested.prepare(df, ["id"], ["a", "b"], "curve", k_outer=2, k_inner=3)
    rules = running.Rules(epochs=4, patience=2)
    for above in (0, 10**9):
        log = {r.number: r for r in nested.search(study, "DE", 1, CONFIGS[:2], holdout_above=above, rules=rules).collect()}
        assert all(r.state == "COMPLETE" and 1 <= r.max_epochs <= 4 and 1 <= len(r.train_losses) <= 4 for r in log.values())
        assert all(r.value == pytest.approx(min(r.train_losses)) or r.value > 0 for r in log.values())
        assert all(r.datetime_start <= r.datetime_complete for r in log.values())
    configs = [{"max_depth": 3, "learning_rate": 0.5, "reg_lambda": 0.1, "n_estimators": 8}, {"max_depth": 2, "learning_rate": 0.5, "reg_lambda": -1.0}]
    for above in (0, 10**9):
        log = {r.number: r for r in nested.search(study, "XGB", 1, configs, holdout_above=above).collect()}
        assert log[0].value == pytest.approx(min(log[0].train_losses) ** (2 if above == 0 else 1))
        assert log[0].max_epochs == log[0].train_losses.index(min(log[0].train_losses)) + 1
        assert log[1].state == "FAIL" and "reg_lambda" in log[1].message
    assert nested.refit_params("XGB", {"max_depth": 3}, 7) == {"max_depth": 3, "n_estimators": 7}
    assert nested.refit_params("DE", {"lr": 1}, 3)["epochs"] == 3 and nested.refit_params("RF", {}, None) == {}
