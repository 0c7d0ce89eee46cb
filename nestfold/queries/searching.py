"""Trial tables, early stopping, pruning, best trials."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from nestfold.operators import space, trials
from nestfold.operators.order import time_bucket, with_position
from nestfold.queries.base import REPORTS_SQL, TRIALS_SQL, query, r, reports, table, trial_log

SEED = 73


def _numbers(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("number"))


# SQL for the closed forms of the draws.
def _u(name: str) -> str:
    return f"(CAST(('0x' || substr(md5('{SEED}|{name}|' || number), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


def _int(name: str, lo: int, hi: int) -> str:
    return f"CAST({lo} + floor({_u(name)} * {hi - lo + 1}) AS INTEGER)"


def _log_int(name: str, lo: int, hi: int) -> str:
    a, b = math.log(lo - 0.5), math.log(hi + 0.5)
    return f"CAST(least({hi}, greatest({lo}, round(exp({a!r}::DOUBLE + {_u(name)} * {b - a!r}::DOUBLE)))) AS INTEGER)"


def _log(name: str, lo: float, hi: float) -> str:
    a, b = math.log(lo), math.log(hi)
    return f"exp({a!r}::DOUBLE + {_u(name)} * {b - a!r}::DOUBLE)"


def _one_of(name: str, *options) -> str:
    items = ", ".join(f"'{o}'" if isinstance(o, str) else str(o).lower() for o in options)
    return f"([{items}])[CAST(floor({_u(name)} * {len(options)}) AS INTEGER) + 1]"


def _named(**columns: str) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in columns.items())


KERNELS = ("rbf", "matern0.5", "matern1.5")
DRAWS_SQL = {
    "RF": _named(n_estimators=_log_int("n_estimators", 10, 500), max_depth=_log_int("max_depth", 5, 100),
                 min_samples_split=_int("min_samples_split", 2, 25), min_samples_leaf=_int("min_samples_leaf", 1, 25),
                 max_features=_one_of("max_features", "sqrt", "auto")),
    "XGB": _named(max_depth=_int("max_depth", 4, 75), **{
        n: f"round(ln({_log(n, lo, hi)}), 6)" for n, lo, hi in (
            ("learning_rate", 0.001, 0.1), ("colsample_bytree", 0.2, 0.6), ("subsample", 0.4, 0.8), ("reg_alpha", 0.01, 10.0),
            ("reg_lambda", 1e-8, 10.0), ("gamma", 1e-8, 10.0), ("min_child_weight", 2, 100))}),
    "DE": _named(lr=f"round(ln({_log('lr', 1e-5, 1e-1)}), 6)", n_max=_int("n_max", 20, 1024), n_layers=_int("n_layers", 2, 6),
                 batch_size=f"CAST({_one_of('batch_size', 512, 1024, 2048, 4096, 8124)} AS INTEGER)"),
    "VDKL": _named(n_max=_int("n_max", 64, 1024), n_layers=_int("n_layers", 2, 5), n_out=_int("n_out", 2, 20),
                   mean_type=_one_of("mean_type", "constant", "linear"), kernel_type=_one_of("kernel_type", *KERNELS),
                   lr=f"round(ln({_log('lr', 1e-4, 1e-1)}), 6)", batch_size=f"CAST({_one_of('batch_size', 512, 1024, 2048)} AS INTEGER)",
                   num_inducing=_log_int("num_inducing", 50, 2000), initialize_fe=_one_of("initialize_fe", True, False),
                   minit=_one_of("minit", "random", "kmeans")),
    "DGP": _named(lr=f"round(ln({_log('lr', 1e-4, 1e-1)}), 6)", kernel_type=_one_of("kernel_type", *KERNELS),
                  batch_size=f"CAST({_one_of('batch_size', 256, 512, 1024)} AS INTEGER)", num_inducing=_log_int("num_inducing", 50, 1000),
                  num_samples=_int("num_samples", 2, 15), n_gp_layers=_log_int("n_gp_layers", 1, 5), n_gp_out=_log_int("n_gp_out", 1, 4)),
    "NNDGP": _named(n_max=_int("n_max", 64, 1024), n_layers=_int("n_layers", 2, 5), n_out=_log_int("n_out", 2, 20),
                    initialize_fe=_one_of("initialize_fe", True, False), lr=f"round(ln({_log('lr', 1e-4, 1e-1)}), 6)",
                    batch_size=f"CAST({_one_of('batch_size', 256, 512, 1024)} AS INTEGER)", num_inducing=_log_int("num_inducing", 50, 800),
                    num_samples=_int("num_samples", 2, 15), n_gp_layers=_log_int("n_gp_layers", 1, 5), n_gp_out=_log_int("n_gp_out", 1, 4)),
    "DSPP": _named(lr=f"round(ln({_log('lr', 1e-4, 1e-1)}), 6)", batch_size=f"CAST({_one_of('batch_size', 256, 512, 1024)} AS INTEGER)",
                   num_inducing=_log_int("num_inducing", 50, 800), num_quadrature_sites=_int("num_quadrature_sites", 5, 10),
                   beta=f"CAST({_one_of('beta', 0.01, 0.05, 0.2, 1.0)} AS DOUBLE)", n_dspp_layers=_log_int("n_dspp_layers", 1, 4),
                   n_dspp_out=_log_int("n_dspp_out", 1, 5)),
}
LOG_SCALED = ("lr", "learning_rate", "colsample_bytree", "subsample", "reg_alpha", "reg_lambda", "gamma", "min_child_weight")


def _shown(df: DataFrame) -> DataFrame:
    """Log-scaled parameters are compared as logarithms."""
    return df.withColumns({c: r(F.log(c)) for c in LOG_SCALED if c in df.columns})


for _model, _columns in DRAWS_SQL.items():
    @query(f"trial_table_{_model.lower()}", f"SELECT number, {_columns} FROM (SELECT o_orderkey AS number FROM orders)")
    def _(spark, d, model=_model):
        return _shown(space.draw_trials(_numbers(spark, d), model, SEED))


@query("trial_table_dkl", f"""WITH a AS (SELECT number, {_named(
    n_max=_int("n_max", 64, 1024), n_layers=_int("n_layers", 2, 5), n_out=_int("n_out", 2, 4), p="0.0::DOUBLE",
    mean_type=_one_of("mean_type", "constant", "linear"), kernel_type=_one_of("kernel_type", *KERNELS, "spectral"),
    lr=f"round(ln({_log('lr', 1e-4, 1e-1)}), 6)", initialize_fe=_one_of("initialize_fe", True, False))} FROM (SELECT o_orderkey AS number FROM orders))
SELECT *, coalesce(CASE WHEN kernel_type = 'spectral' THEN {_int("num_mixtures", 2, 8)} END, 0) AS num_mixtures,
 CASE WHEN n_out <= 2 THEN {_int("grid_size", 10, 400)} WHEN n_out = 3 THEN {_int("grid_size", 10, 50)} ELSE {_int("grid_size", 10, 20)} END AS grid_size FROM a""")
def _(spark, d):
    drawn = _shown(space.draw_trials(_numbers(spark, d), "DKL", SEED))
    return drawn.withColumn("num_mixtures", F.coalesce("num_mixtures", F.lit(0)))


@query("trial_table_rf_holdout", f"""SELECT number, {_named(
    n_estimators=_log_int("n_estimators", 10, 250), max_depth=_log_int("max_depth", 5, 50), min_samples_split=_int("min_samples_split", 2, 15),
    min_samples_leaf=_int("min_samples_leaf", 1, 15), max_features=_one_of("max_features", "sqrt", "auto"))} FROM (SELECT o_orderkey AS number FROM orders)""")
def _(spark, d):
    return space.draw_trials(_numbers(spark, d), "RF", SEED, holdout=True)


@query("default_trials_first", f"""WITH drawn AS (SELECT number, {DRAWS_SQL['VDKL']} FROM (SELECT o_orderkey AS number FROM orders))
SELECT number, CASE WHEN number = 0 THEN 1024 ELSE n_max END AS n_max, CASE WHEN number = 0 THEN 4 ELSE n_layers END AS n_layers,
 CASE WHEN number = 0 THEN 8 ELSE n_out END AS n_out, CASE WHEN number = 0 THEN 'constant' ELSE mean_type END AS mean_type,
 CASE WHEN number = 0 THEN 'rbf' ELSE kernel_type END AS kernel_type, CASE WHEN number = 0 THEN round(ln(0.01), 6) ELSE lr END AS lr,
 batch_size, CASE WHEN number = 0 THEN 1000 ELSE num_inducing END AS num_inducing,
 CASE WHEN number = 0 THEN false ELSE initialize_fe END AS initialize_fe, minit FROM drawn""")
def _(spark, d):
    drawn = space.draw_trials(_numbers(spark, d), "VDKL", SEED)
    return _shown(space.with_defaults(drawn, [space.SPACES["VDKL"].default]))


# -- early stopping ----------------------------------------------------------------

def _walk_sql(source: str, patience: int, delta: str) -> str:
    worse = f"(-r.value < w.best + {delta}::DOUBLE)"
    return f"""walk AS (
  SELECT study, number, step, -value AS best, step AS best_step, 0 AS bad, false AS stopped FROM {source} WHERE step = 0
  UNION ALL
  SELECT r.study, r.number, r.step, CASE WHEN {worse} THEN w.best ELSE -r.value END, CASE WHEN {worse} THEN w.best_step ELSE r.step END,
    CASE WHEN {worse} THEN w.bad + 1 ELSE 0 END, {worse} AND w.bad + 1 >= {patience}
  FROM walk w JOIN {source} r ON r.study = w.study AND r.number = w.number AND r.step = w.step + 1 WHERE NOT w.stopped),
ends AS (SELECT study, number, round(-arg_max(best, step), 6) AS best_value, arg_max(best_step, step) AS best_step,
    CASE WHEN arg_max(stopped, step) THEN max(step) ELSE -1 END AS stop_step FROM walk GROUP BY study, number)"""


def _ends(df: DataFrame) -> DataFrame:
    return df.select("study", "number", r("best_value").alias("best_value"), "best_step", F.coalesce("stop_step", F.lit(-1)).alias("stop_step"))


@query("early_stopping", f"WITH RECURSIVE {REPORTS_SQL}, {_walk_sql('reports', 3, '0.00000001')} SELECT * FROM ends")
def _(spark, d):
    return _ends(trials.early_stopping(reports(spark, d), patience=3, delta=1e-8))


@query("early_stopping_min_gain", f"WITH RECURSIVE {REPORTS_SQL}, {_walk_sql('reports', 4, '7.5')} SELECT * FROM ends")
def _(spark, d):
    return _ends(trials.early_stopping(reports(spark, d), patience=4, delta=7.5))


@query("early_stopping_keep_best", f"""WITH RECURSIVE {REPORTS_SQL}, {_walk_sql('reports', 7, '0')}
SELECT e.*, r.event_id FROM ends e JOIN reports r ON r.study = e.study AND r.number = e.number AND r.step = e.best_step""")
def _(spark, d):
    kept = trials.early_stopping_with_best(reports(spark, d, stored=True), ["event_id"], patience=7)
    return kept.select("study", "number", r("best_value").alias("best_value"), "best_step",
                       F.coalesce("stop_step", F.lit(-1)).alias("stop_step"), "event_id")


@query("lockstep_cv_stopping", f"""WITH RECURSIVE folded AS (
  SELECT event_type AS study, CAST(user_id AS INTEGER) AS number, event_id % 4 AS fold, round(value * 100) AS value,
    row_number() OVER (PARTITION BY event_type, user_id, event_id % 4 ORDER BY ts, event_id) - 1 AS step FROM events),
lock AS (SELECT study, number, step, avg(value) AS value FROM folded GROUP BY study, number, step HAVING count(DISTINCT fold) = 4),
{_walk_sql('lock', 2, '0.00000001')} SELECT * FROM ends""")
def _(spark, d):
    events = table(spark, d, "events").select(
        F.col("event_type").alias("study"), F.col("user_id").cast("int").alias("number"), (F.col("event_id") % 4).alias("fold"),
        "event_id", "ts", F.round(F.col("value") * 100).alias("value"))
    placed = with_position(events, ["study", "number", "fold"], ["ts", "event_id"], time_bucket("ts", "day"), out="step")
    return _ends(trials.early_stopping(trials.lockstep_average(placed, "fold", 4), patience=2, delta=1e-8))


@query("epoch_budget", f"""WITH {REPORTS_SQL}, {TRIALS_SQL}, b AS (SELECT study, number,
 CAST(CASE WHEN n_reports - 1 = 14 THEN 15 ELSE greatest(1, n_reports - 1 - 5 + 1) END AS INTEGER) AS max_epochs FROM trials)
SELECT study, number, max_epochs, CAST(floor(max_epochs * 1.2::DOUBLE) AS INTEGER) AS refit_epochs FROM b""")
def _(spark, d):
    log = trial_log(reports(spark, d))
    budget = log.select("study", "number", trials.epoch_budget(F.col("n_reports") - 1, 15, 5).alias("max_epochs"))
    return budget.withColumn("refit_epochs", trials.refit_budget(F.col("max_epochs"), 1.2))


@query("time_budget", f"""WITH {REPORTS_SQL}, e AS (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY study, number)) / 1000000 AS elapsed FROM reports),
c AS (SELECT study, number, min(step) FILTER (elapsed > 604800) AS cut FROM e GROUP BY study, number)
SELECT e.study, e.number, coalesce(any_value(cut), -1) AS stop_step, round(min(value), 6) AS best_value
FROM e JOIN c ON e.study = c.study AND e.number = c.number WHERE cut IS NULL OR step <= cut GROUP BY e.study, e.number""")
def _(spark, d):
    from nestfold.functions.metrics import seconds_between

    rows = reports(spark, d, stored=True)
    starts = rows.groupBy("study", "number").agg(F.min("ts").alias("start"))
    timed = rows.join(starts, ["study", "number"]).withColumn("elapsed", seconds_between(F.col("start"), F.col("ts")))
    out = trials.time_budget(timed, 604800)
    return out.select("study", "number", F.coalesce("stop_step", F.lit(-1)).alias("stop_step"), r("best_value").alias("best_value"))


# -- pruning -------------------------------------------------------------------------

@query("median_pruning", f"""WITH {REPORTS_SQL}, {TRIALS_SQL},
cents AS (SELECT study, number, step, round(value * 100) AS value, round(min(value) OVER (PARTITION BY study, number ORDER BY step) * 100) AS best FROM reports),
checks AS (SELECT * FROM cents WHERE step >= 4 AND (step - 4) % 2 = 0),
prior AS (SELECT c.study, c.number, count(o.number) AS n FROM trials c LEFT JOIN trials o ON o.study = c.study AND o.number < c.number AND o.state = 'COMPLETE' GROUP BY c.study, c.number),
med AS (SELECT c.study, c.number, c.step, any_value(c.best) AS best, quantile_cont(o.value, 0.5) AS median
  FROM checks c JOIN prior p ON p.study = c.study AND p.number = c.number AND p.n >= 5
  JOIN cents o ON o.study = c.study AND o.step = c.step AND o.number < c.number
  JOIN trials t ON t.study = o.study AND t.number = o.number AND t.state = 'COMPLETE' GROUP BY c.study, c.number, c.step),
cut AS (SELECT study, number, min(step) AS step FROM med WHERE best > median GROUP BY study, number)
SELECT t.study, t.number, coalesce(cut.step, -1) AS pruned_step
FROM (SELECT DISTINCT study, number FROM checks) t LEFT JOIN cut ON cut.study = t.study AND cut.number = t.number""")
def _(spark, d):
    rows = reports(spark, d, stored=True)
    log = trial_log(rows)
    cents = rows.withColumn("value", F.round(F.col("value") * 100))
    out = trials.median_pruning(cents, log, startup=5, warmup=4, interval=2)
    return out.withColumn("pruned_step", F.coalesce("pruned_step", F.lit(-1)))


@query("hyperband", f"""WITH {REPORTS_SQL},
member AS (SELECT *, number % 2 AS bracket FROM reports),
r0 AS (SELECT study, bracket, number, step, value FROM member WHERE (bracket = 0 AND step = 2) OR (bracket = 1 AND step = 8)),
k0 AS (SELECT *, row_number() OVER (PARTITION BY study, bracket ORDER BY value, number) AS i, count(*) OVER (PARTITION BY study, bracket) AS n FROM r0),
c0 AS (SELECT study, bracket, value AS cut FROM k0 WHERE i = greatest(1, n // 3)),
j0 AS (SELECT r0.*, value <= cut AS passed FROM r0 JOIN c0 USING (study, bracket)),
r1 AS (SELECT m.study, m.bracket, m.number, m.step, m.value FROM member m JOIN j0 ON j0.study = m.study AND j0.number = m.number AND j0.passed WHERE m.bracket = 0 AND m.step = 8),
k1 AS (SELECT *, row_number() OVER (PARTITION BY study, bracket ORDER BY value, number) AS i, count(*) OVER (PARTITION BY study, bracket) AS n FROM r1),
c1 AS (SELECT study, bracket, value AS cut FROM k1 WHERE i = greatest(1, n // 3)),
j1 AS (SELECT r1.*, value <= cut AS passed FROM r1 JOIN c1 USING (study, bracket)),
j AS (SELECT * FROM j0 UNION ALL SELECT * FROM j1),
o AS (SELECT study, number, CAST(sum(CASE WHEN passed THEN 1 ELSE 0 END) AS INTEGER) AS rungs_passed, min(step) FILTER (NOT passed) AS dropped_step FROM j GROUP BY study, number)
SELECT a.study, a.number, CAST(a.bracket AS INTEGER) AS bracket, coalesce(rungs_passed, 0) AS rungs_passed, coalesce(dropped_step, -1) AS dropped_step
FROM (SELECT DISTINCT study, number, bracket FROM member) a LEFT JOIN o ON o.study = a.study AND o.number = a.number""")
def _(spark, d):
    out = trials.hyperband(reports(spark, d, stored=True), min_resource=3, max_resource=24)
    return out.withColumn("dropped_step", F.coalesce("dropped_step", F.lit(-1)))


# -- choosing --------------------------------------------------------------------------

@query("best_trial", f"""WITH {REPORTS_SQL}, {TRIALS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY study ORDER BY value, number) AS i FROM trials WHERE state = 'COMPLETE' AND value IS NOT NULL)
SELECT study, number, round(value, 6) AS value, state, n_reports FROM k WHERE i = 1""")
def _(spark, d):
    best = trials.best_trial(trial_log(reports(spark, d)).drop("start", "end"))
    return best.select("study", "number", r("value").alias("value"), "state", "n_reports")


@query("flatten_trials", f"""SELECT number, CAST({_log_int("n_estimators", 10, 500)} AS VARCHAR) AS params_n_estimators, CAST({_log_int("max_depth", 5, 100)} AS VARCHAR) AS params_max_depth,
 {_one_of("max_features", "sqrt", "auto")} AS params_max_features, 'policies' AS dataset_name, CAST(1 AS INTEGER) AS outer_cv_split FROM (SELECT o_orderkey AS number FROM orders)""")
def _(spark, d):
    names = ("n_estimators", "max_depth", "max_features")
    drawn = space.draw_trials(_numbers(spark, d), "RF", SEED)
    packed = drawn.select("number", F.map_from_arrays(
        F.array(*map(F.lit, names)), F.array(*[F.col(n).cast("string") for n in names])).alias("params"))
    return trials.flatten(packed, names, dataset_name="policies", outer_cv_split=1)


@query("failed_trials", f"""WITH {REPORTS_SQL}, {TRIALS_SQL}
SELECT study, state, count(*) AS trials, CAST(sum(CASE WHEN state = 'COMPLETE' AND value IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS usable FROM trials GROUP BY study, state""")
def _(spark, d):
    return trials.state_counts(trial_log(reports(spark, d)))


@query("end_at_nan", f"""WITH {REPORTS_SQL}, n AS (SELECT *, value > 120 AS bad FROM reports), e AS (SELECT study, number, min(step) FILTER (bad) AS nan_step FROM n GROUP BY study, number)
SELECT e.study, e.number, coalesce(any_value(nan_step), -1) AS nan_step, coalesce(round(min(n.value) FILTER (nan_step IS NULL OR n.step < nan_step), 6), -1) AS best_value
FROM e JOIN n ON n.study = e.study AND n.number = e.number GROUP BY e.study, e.number""")
def _(spark, d):
    rows = reports(spark, d, stored=True).withColumn("value", F.when(F.col("value") > 120, F.lit(float("nan"))).otherwise(F.col("value")))
    out = trials.end_at_nan(rows)
    return out.select("study", "number", F.coalesce("nan_step", F.lit(-1)).alias("nan_step"), r(F.coalesce("best_value", F.lit(-1.0))).alias("best_value"))
