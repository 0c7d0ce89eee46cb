import random
import statistics

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from nestfold.operators import space, trials


def replay(losses, patience, delta):
    """The rule as a loop: (best, position of best, stop position or None)."""
    best = at = None
    bad = 0
    for i, loss in enumerate(losses):
        if best is None or not (-loss < -best + delta):
            best, at, bad = loss, i, 0
        else:
            bad += 1
            if bad >= patience:
                return best, at, i
    return best, at, None


def reports_of(spark, series):
    rows = [("s", n, i, i, float(v)) for n, vs in enumerate(series) for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "study string, number int, pos bigint, step bigint, value double")


def check(spark, series, patience, delta, chunk):
    got = {r.number: (r.best_value, r.best_pos, r.stop_pos) for r in trials.early_stopping(reports_of(spark, series), patience, delta, chunk=chunk).collect()}
    assert got == {n: replay(vs, patience, delta) for n, vs in enumerate(series) if vs}


def test_early_stopping_hand_cases(spark):
    check(spark, [[3], [3, 3, 3, 3], [1, 2, 3, 4], [4, 3, 2, 1], [1, 2, 1, 2, 2], [5, 4, 6, 7, 3]], 2, 0.0, 4096)


@pytest.mark.parametrize("patience,delta,chunk", [(3, 0.0, 4), (2, 0.7, 5), (4, 1e-8, 4), (1, 0.5, 3), (7, 2.5, 16)])
def test_early_stopping_across_chunks(spark, patience, delta, chunk):
    """Long trials are cut into tiny chunks; several levels of linking are needed."""
    rng = random.Random(patience * 100 + chunk)
    series = [[rng.randint(0, 30) for _ in range(rng.randint(1, 40))] for _ in range(30)]
    series += [[max(0.0, 60 - i + rng.choice([0, 0, 1.5, -1])) for i in range(60)] for _ in range(10)]
    check(spark, series, patience, delta, chunk)


def test_patience_reached_at_the_last_report(spark):
    check(spark, [[1, 2, 2], [1, 2]], 2, 0.0, 4)


def test_best_report_payload(spark):
    df = reports_of(spark, [[5, 4, 4, 6]]).withColumn("weights", F.concat(F.lit("w"), "pos"))
    got = trials.early_stopping_with_best(df, ["weights"]).collect()[0]
    assert got.weights == "w2"  # a tie counts as better


def test_epoch_budget(spark):
    df = spark.createDataFrame([(399,), (30,), (2,)], "last int")
    got = [r.b for r in df.select(trials.epoch_budget(F.col("last"), 400, 5).alias("b")).collect()]
    assert got == [400, 26, 1]


def test_time_budget_counts_the_report_that_breaks_it(spark):
    rows = [("s", 1, i, float(e), v) for i, (e, v) in enumerate([(1, 5.0), (2, 4.0), (11, 3.0), (12, 1.0)])]
    rows += [("s", 2, 0, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "study string, number int, step int, elapsed double, value double")
    got = {r.number: (r.stop_step, r.best_value) for r in trials.time_budget(df, 10).collect()}
    assert got == {1: (2, 3.0), 2: (None, 2.0)}


def median_by_pairs(series, states, startup, warmup, interval):
    out = {}
    for n, vs in enumerate(series):
        earlier = [m for m in range(n) if states[m] == "COMPLETE"]
        for s, _ in enumerate(vs):
            if s < warmup or (s - warmup) % interval or len(earlier) < startup:
                continue
            seen = [series[m][s] for m in earlier if s < len(series[m])]
            if seen and min(vs[:s + 1]) > statistics.median(seen):
                out[n] = s
                break
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_median_pruning_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    series = [[rng.randint(0, 12) for _ in range(rng.randint(1, 12))] for _ in range(45)]
    states = [rng.choice(["COMPLETE", "COMPLETE", "PRUNED"]) for _ in series]
    log = spark.createDataFrame([("s", n, s) for n, s in enumerate(states)], "study string, number int, state string")
    got = trials.median_pruning(reports_of(spark, series), log, startup=3, warmup=1, interval=2).filter("pruned_step is not null").collect()
    assert {r.number: r.pruned_step for r in got} == median_by_pairs(series, states, 3, 1, 2)


def test_hyperband_hand_case(spark):
    # Bracket 0 (even numbers): rungs after 1 and 3 epochs; bracket 1: after 3 only.
    series = [[n + 1.0, n + 1.0, n + 1.0] for n in range(12)]
    got = {r.number: (r.bracket, r.rungs_passed, r.dropped_step) for r in trials.hyperband(reports_of(spark, series), 1, 3).collect()}
    assert got[0] == (0, 2, None) and got[2] == (0, 1, 2) and got[4] == (0, 0, 0)
    assert got[1] == (1, 1, None) and got[3] == (1, 1, None) and got[5] == (1, 0, 2)


def test_hyperband_has_no_rung_beyond_the_largest_resource(spark):
    got = trials.hyperband(reports_of(spark, [[1.0] * 30 for _ in range(4)]), 3, 24).collect()
    assert {(r.number, r.rungs_passed) for r in got} == {(0, 2), (1, 1), (2, 2), (3, 1)}


def test_best_trial_skips_failed_and_nan(spark):
    rows = [("s", 0, None, "FAIL"), ("s", 1, float("nan"), "COMPLETE"), ("s", 2, 1.0, "COMPLETE"), ("s", 3, 1.0, "COMPLETE"), ("s", 4, 0.1, "PRUNED")]
    df = spark.createDataFrame(rows, "study string, number int, value double, state string")
    assert trials.best_trial(df).collect()[0].number == 2
    counts = {r.state: (r.trials, r.usable) for r in trials.state_counts(df).collect()}
    assert counts == {"FAIL": (1, 0), "COMPLETE": (3, 2), "PRUNED": (1, 0)}


def test_nan_ends_a_trial(spark):
    df = reports_of(spark, [[3, 2, float("nan"), 1], [float("nan")], [4]])
    got = {r.number: (r.nan_step, r.best_value) for r in trials.end_at_nan(df).collect()}
    assert got == {0: (2, 2.0), 1: (0, None), 2: (None, 4.0)}


def test_lockstep_leaves_out_unfinished_epochs(spark):
    rows = [("s", 1, f, s, float(f + s)) for f in (0, 1) for s in range(3) if not (f == 1 and s == 2)]
    df = spark.createDataFrame(rows, "study string, number int, fold int, step bigint, value double")
    assert sorted(r.value for r in trials.lockstep_average(df, "fold", 2).collect()) == [0.5, 1.5]


@pytest.mark.parametrize("model", sorted(space.SPACES))
@pytest.mark.parametrize("holdout", [False, True])
def test_draws_stay_in_range(spark, model, holdout):
    names = space.SPACES[model].form(holdout)
    rows = space.draw_trials(spark.range(400).withColumnRenamed("id", "number"), model, 1, holdout=holdout).collect()
    for name, dist in names.items():
        seen = [r[name] for r in rows if r[name] is not None]
        assert seen
        if isinstance(dist, (space.Int, space.Float)):
            assert dist.low * (1 - 1e-12) <= min(seen) and max(seen) <= dist.high * (1 + 1e-12)
        elif isinstance(dist, space.Choice):
            assert set(seen) == set(dist.options)


def test_conditional_parameter(spark):
    rows = space.draw_trials(spark.range(300).withColumnRenamed("id", "number"), "DKL", 5).collect()
    assert all((r.num_mixtures is not None) == (r.kernel_type == "spectral") for r in rows)
    assert all(r.grid_size <= 20 for r in rows if r.n_out == 4)
