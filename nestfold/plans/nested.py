"""Nested resampling: search on inner folds or a hold-out, refit, score the outer folds.

Load, encode, fold and scale are lazy plans over all rows. The driver only loops
over outer runs and trials, i.e. over model fits, and holds settings and scores.
"""

from __future__ import annotations

import threading
import time
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce
from multiprocessing.pool import ThreadPool
from typing import Any, Callable, Mapping, Sequence

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.errors import IllegalArgumentException
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from nestfold.functions import metrics
from nestfold.models import boost, forest, gp, joint, net, trees, tuned
from nestfold.operators import scale, split
from nestfold.operators.trials import best_trial
from nestfold.plans import running
from nestfold.sources.results import RESULT_SCHEMA, TRIAL_SCHEMA
from nestfold.sources.runlog import RunLog
from nestfold.sources.storage import fresh_path, materialize

N_MEMBERS = 5  # fixed value: networks of an ensemble
# The most boosting rounds by strategy, and the patience of their stopping rule.
BOOST_ROUNDS = {"cv": 10_000, "holdout": 1_000}
BOOST_PATIENCE = 10
NETWORK_EPOCHS = 100

# A fitted model: rows with ``features`` in, kept columns plus pred_mean (and
# pred_var where the model has one) out.
Predictor = Callable[[DataFrame, Sequence[str]], DataFrame]


@dataclass
class Study:
    """A prepared table: key, feature columns, ``y``, ``outer_fold``, ``inner_folds``."""

    rows: DataFrame
    key: list[str]
    features: list[str]
    dataset_name: str
    k_outer: int = 5
    k_inner: int = 4
    dataset_id: int | None = None
    _stats: dict | None = None

    @property
    def stats(self) -> dict[int, dict[str, dict[str, float]]]:
        """Training statistics of all outer runs, from one pass over the table."""
        if self._stats is None:
            self._stats = scale.fit(self.rows, [*self.features, "y"], "outer_fold").constants()
        return self._stats


def prepare(df: DataFrame, key: Sequence[str], features: Sequence[str], dataset_name: str, target: str = "y",
            k_outer: int = 5, k_inner: int = 4, dataset_id: int | None = None) -> Study:
    """Assign nested folds and write the table once; all fits read it from there.

    It is partitioned by outer fold, so a run reads only the folds it needs.

    Small tables are spread by key, so that all cores get some rows.
    """
    folded = split.with_nested_folds(df, key, k_outer, k_inner)
    rows = folded.select(*key, *[F.col(f"`{c}`").cast("double").alias(c) for c in features],
                         F.col(target).cast("double").alias("y"), "outer_fold", "inner_folds")
    return Study(materialize(_spread(rows, key), f"study-{dataset_name}", ["outer_fold"]), list(key), list(features), dataset_name, k_outer, k_inner, dataset_id)


ROWS_PER_TASK = 5_000  # fewer are not worth a task of their own
SMALL_TABLE = 10_000_000  # rows that are cheap to spread anew


def _spread(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Spread a small table over the cores; a large one keeps the splits it came with."""
    n = rows.count()
    if n > SMALL_TABLE:
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(1, min(cores, n // ROWS_PER_TASK)), *key)


class Once:
    """Something that the trials of a search make once; a failure is not kept."""

    def __init__(self):
        self._lock, self._made = threading.Lock(), None

    def get(self, make: Callable[[], Any]) -> Any:
        with self._lock:
            if self._made is None:
                self._made = make()
            return self._made


@dataclass(frozen=True)
class Family:
    """How a model family scales its data, and how it is fitted."""

    fit: Callable[[DataFrame, Study, Mapping[str, Any]], Predictor]
    scale_x: str | None = None
    scale_y: bool = True
    learners: Callable[[Study, Mapping[str, Any], int], list[net.Learner]] | None = None  # set for families that a running search trains
    fit_runs: Callable[[Study, Mapping[int, Mapping[str, Any]]], dict[int, Predictor]] | None = None  # all outer runs in the same passes
    altered: Callable[[Mapping[str, Any]], str | None] | None = None  # which settings run otherwise than given
    fit_parts: Callable[[DataFrame, Study, Mapping[str, Any], Sequence[Column], Once | None], list[Predictor]] | None = None  # several parts of the rows at once
    budget: str | None = None  # the setting that the best trial's epochs or rounds go to


def scaled(study: Study, family: Family, run: int) -> DataFrame:
    """All rows as seen by outer run ``run``: scaled by its training part.

    ``t`` is the target to fit; ``y`` stays in its own units for scoring. This is
    a scan with a projection: cheap enough for every pass of a fit to repeat, so
    no run and no trial writes a copy of the table.
    """
    s = study.stats[run]
    op = {None: lambda x, _: x, "minmax": scale.minmax, "standard": scale.standardize}[family.scale_x]
    features = F.array(*[op(F.col(f"`{c}`"), s[c]).cast("float") for c in study.features])
    t = scale.minmax(F.col("y"), s["y"]) if family.scale_y else F.col("y")
    return study.rows.select(*study.key, "outer_fold", F.element_at("inner_folds", run).alias("inner_fold"),
                             features.alias("features"), t.alias("t"), "y")


def unscaled(predictions: DataFrame, study: Study, family: Family, run: int) -> DataFrame:
    """Predictions in the target's own units, variances floored."""
    s = study.stats[run]["y"]
    has_var = "pred_var" in predictions.columns
    if family.scale_y:
        predictions = predictions.withColumn("pred_mean", scale.minmax_inverse(F.col("pred_mean"), s))
        if has_var:
            predictions = predictions.withColumn("pred_var", scale.rescale_variance(F.col("pred_var"), s))
    if has_var:
        predictions = predictions.withColumn("pred_var", metrics.floor_variance(F.col("pred_var")))
    return predictions


# -- families -----------------------------------------------------------------------

def _vectors(df: DataFrame) -> DataFrame:
    return df.withColumn("vector", array_to_vector(F.col("features").cast("array<double>")))


def _tree_predictor(model) -> Predictor:
    return lambda df, keep: model.transform(_vectors(df)).select(*keep, "pred_mean")


def fit_forest(train: DataFrame, study: Study, params: Mapping[str, Any]) -> Predictor:
    return _tree_predictor(trees.forest(params, label="t").fit(_vectors(train)))


def fit_grown_forest(train: DataFrame, study: Study, params: Mapping[str, Any]) -> Predictor:
    return fit_forest_parts(train, study, params, [F.lit(True)])[0]


def fit_forest_parts(train: DataFrame, study: Study, params: Mapping[str, Any], parts: Sequence[Column], once: Once | None = None) -> list[Predictor]:
    """A forest for each condition on the rows, such as all but one inner fold, in the same passes.

    Calls with the same ``once`` share the binned table, as rows and parts do not depend on the settings.
    """
    fits = [forest.Fit(forest.Settings.of(params), part) for part in parts]
    table = (once or Once()).get(lambda: forest.prepare(train, parts, study.key, len(study.features)))
    return [m.predict for m in forest.fit_table(table, fits)]


def fit_forest_runs(study: Study, params_of_run: Mapping[int, Mapping[str, Any]]) -> dict[int, Predictor]:
    """All outer runs on one binned table; predictions are in the scale of each run's target."""
    fits = [forest.Fit(forest.Settings.of(params), F.col("outer_fold") != run, _target_scale(study, run)) for run, params in params_of_run.items()]
    models = forest.fit_many(_plain_rows(study), fits, study.key, len(study.features), label="y")
    return {run: m.predict for run, m in zip(params_of_run, models)}


def _target_scale(study: Study, run: int) -> tuple[float, float]:
    y = study.stats[run]["y"]
    return 1 / y["range"], -y["min"] / y["range"]


def _plain_rows(study: Study) -> DataFrame:
    features = F.array(*[F.col(f"`{c}`").cast("float") for c in study.features])
    return study.rows.select(*study.key, "outer_fold", features.alias("features"), "y")


def fit_boosted(train: DataFrame, study: Study, params: Mapping[str, Any]) -> Predictor:
    """``n_estimators`` rounds; rows of a column ``is_validation``, if there, decide when to stop."""
    held = F.col("is_validation") if "is_validation" in train.columns else None
    one = boost.Fit(boost.Settings.of(params), F.lit(True) if held is None else ~held, held,
                    rounds=int(params.get("n_estimators", BOOST_ROUNDS["holdout"])))
    return boost.fit_many(train, [one], study.key, len(study.features), BOOST_PATIENCE)[0].predict


def fit_boosted_runs(study: Study, params_of_run: Mapping[int, Mapping[str, Any]]) -> dict[int, Predictor]:
    """All outer runs on one binned table; each scales the target by its own training rows."""
    fits = []
    for run, params in params_of_run.items():
        fits.append(boost.Fit(boost.Settings.of(params), F.col("outer_fold") != run, group=run, scale=_target_scale(study, run),
                              rounds=int(params.get("n_estimators", BOOST_ROUNDS["holdout"]))))
    models = boost.fit_many(_plain_rows(study), fits, study.key, len(study.features), label="y")
    return {run: m.predict for run, m in zip(params_of_run, models)}


def fit_ensemble(train: DataFrame, study: Study, params: Mapping[str, Any]) -> Predictor:
    shape = net.mean_variance_net(len(study.features), int(params["n_max"]), int(params["n_layers"]))
    fitted = net.fit(
        train, shape, int(params.get("n_members", N_MEMBERS)), float(params["lr"]),
        int(params.get("epochs", 100)), int(params["batch_size"]), patience=int(params.get("patience", 10)), target="t")
    return fitted.predict


def ensemble_learners(study: Study, params: Mapping[str, Any], fold: int) -> list[net.Learner]:
    """The members that a running search trains without ``fold``."""
    shape = net.mean_variance_net(len(study.features), int(params["n_max"]), int(params["n_layers"]))
    return [net.Learner.fresh(shape, float(params["lr"]), int(params["batch_size"]), fold, 73 + i)
            for i in range(int(params.get("n_members", N_MEMBERS)))]


def fit_deep_kernel(train: DataFrame, study: Study, params: Mapping[str, Any]) -> Predictor:
    """Extractor, its outputs scaled into (0, 1), then a sparse GP on them.

    The extractor is pretrained on the target, the GP is then fitted in closed
    form; with ``joint_steps``, both then follow the gradient of the bound together, with a constant mean.
    """
    extractor = net.pretrain_extractor(
        train, len(study.features), int(params["n_max"]), int(params["n_layers"]), int(params["n_out"]),
        lr=float(params.get("lr", 1e-3)), batch_size=int(params.get("batch_size", 2048)),
        epochs=params.get("epochs"), target="t")
    # A few numbers per row, read by several passes: worth writing.
    learned = materialize(extractor.transform(train, [*study.key, "t"]), "learned")
    bounds = scale.array_bounds(learned, "features").collect()[0]
    lo, hi = F.lit(list(bounds.lo)), F.lit(list(bounds.hi))
    inside = lambda df: df.withColumn("features", scale.scale_to_bounds(F.col("features"), lo, hi))
    steps = int(params.get("joint_steps", 0))
    model = _sparse_gp(inside(learned), study, {**params, "mean_type": "constant"} if steps else params)
    if steps:
        trained, _ = joint.fit(train, *joint.extractor_of(extractor, np.array(bounds.lo), np.array(bounds.hi)), model, steps, target="t")
        return trained.predict
    return lambda df, keep: model.predict(inside(extractor.transform(df, keep)), keep)


def fit_sparse_gp(train: DataFrame, study: Study, params: Mapping[str, Any]) -> Predictor:
    return _sparse_gp(train, study, params).predict


def _sparse_gp(train: DataFrame, study: Study, params: Mapping[str, Any]) -> gp.SparseGP:
    m, kind = int(params["num_inducing"]), params["kernel_type"]
    if params.get("minit", "random") == "kmeans":
        points = gp.kmeans_points(train, study.key, m)
    else:
        points = gp.random_points(train, study.key, m)
    spread = gp.feature_spread(train)
    if kind == "spectral":
        kernels = gp.spectral_kernels(spread, int(params["num_mixtures"]))
    else:
        kernels = gp.candidate_kernels(kind, spread)
    mean = gp.fit_mean(train, params.get("mean_type", "constant"), target="t")
    model = gp.fit(train, points, kernels, mean, target="t")
    steps = int(params.get("tuning_steps", 0))  # on the gradient of the bound, from the best of the candidates
    return tuned.fit(train, model, steps, target="t")[0] if steps else model


FAMILIES = {
    "RF": Family(fit_forest, altered=trees.altered),
    "GRF": Family(fit_grown_forest, fit_runs=fit_forest_runs, fit_parts=fit_forest_parts),
    "XGB": Family(fit_boosted, fit_runs=fit_boosted_runs, budget="n_estimators"),
    "DE": Family(fit_ensemble, scale_x="standard", scale_y=False, learners=ensemble_learners, budget="epochs"),
    "VDKL": Family(fit_deep_kernel, scale_x="minmax"),
    "SGP": Family(fit_sparse_gp, scale_x="minmax"),
}
# What a search minimises, by strategy, where it is not the MSE.
SEARCH_METRIC = {("XGB", "cv"): "rmse"}


def _at_once(spark: SparkSession, fn: Callable, items: Sequence, parallelism: int) -> list:
    """Run independent jobs from a few driver threads, results in order."""
    with ThreadPool(min(parallelism, len(items)) or 1) as pool:
        return pool.map(inheritable_thread_target(spark)(fn), items)


# -- search -------------------------------------------------------------------------

def _metric_on(predictor: Predictor, rows: DataFrame, metric: metrics.Metric) -> float:
    scored = predictor(rows, ["t"])
    return scored.agg(metric(F.col("pred_mean"), F.col("t")).alias("s")).collect()[0].s


@dataclass
class Outcome:
    """What a trial came to; ``epochs`` is the budget for its refit, ``losses`` its validation errors by round."""

    value: float | None
    epochs: int | None = None
    losses: list[float] | None = None
    state: str = "COMPLETE"
    began: datetime | None = None
    ended: datetime | None = None
    message: str | None = None


def cv_objective(study: Study, family: Family, train: DataFrame, params: Mapping[str, Any], metric: metrics.Metric = metrics.mse,
                 once: Once | None = None) -> float:
    """Fit per inner fold, score the left-out fold, mean over folds."""
    folds = range(1, study.k_inner + 1)
    if family.fit_parts:
        models = family.fit_parts(train, study, params, [F.col("inner_fold") != fold for fold in folds], once)
        scores = _at_once(train.sparkSession, lambda f: _metric_on(models[f - 1], train.filter(F.col("inner_fold") == f), metric), folds, len(folds))
    else:
        models = (family.fit(train.filter(F.col("inner_fold") != fold), study, params) for fold in folds)
        scores = [_metric_on(fitted, train.filter(F.col("inner_fold") == fold), metric) for fold, fitted in zip(folds, models)]
    return sum(scores) / len(scores)


def holdout_objective(study: Study, family: Family, train: DataFrame, params: Mapping[str, Any], metric: metrics.Metric = metrics.mse,
                      once: Once | None = None) -> float:
    """Fit on three quarters of the training rows, score the rest."""
    if family.fit_parts:
        fitted = family.fit_parts(train, study, params, [~F.col("is_test")], once)[0]
    else:
        fitted = family.fit(train.filter(~F.col("is_test")), study, params)
    return _metric_on(fitted, train.filter("is_test"), metric)


def boosted_objective(study: Study, train: DataFrame, params: Mapping[str, Any], strategy: str) -> Outcome:
    """Boosting with the validation folds, or the hold-out, deciding when to stop.

    The folds take their rounds in lockstep. The value is the average RMSE of the
    best round for folds, and the MSE there for a hold-out.
    """
    settings, rounds = boost.Settings.of(params), int(params.get("n_estimators", BOOST_ROUNDS[strategy]))
    held = [F.col("is_test")] if strategy == "holdout" else [F.col("inner_fold") == f for f in range(1, study.k_inner + 1)]
    models = boost.fit_many(train, [boost.Fit(settings, ~h, h, rounds=rounds) for h in held], study.key, len(study.features), BOOST_PATIENCE)
    losses = [sum(e) / len(e) for e in zip(*[m.errors for m in models])]
    best = len(models[0].trees)
    value = losses[best - 1] if best else float("nan")
    return Outcome(value ** 2 if strategy == "holdout" else value, best, losses)


def running_search(study: Study, family: Family, train: DataFrame, configs: Sequence[Mapping[str, Any]], strategy: str,
                   rules: running.Rules, path: str | None = None, study_name: str = "search") -> list[Outcome]:
    """Outcomes of a search over networks whose trials train together; ``path`` lets it go on after a failure."""
    fold = F.col("inner_fold") if strategy == "cv" else F.when(F.col("is_test"), 1).otherwise(0)
    folds = range(1, study.k_inner + 1) if strategy == "cv" else [1]
    trials = running.run(
        train.select("features", "t", fold.alias("fold")), folds, configs, lambda c, f: family.learners(study, c, f),
        rules, path or fresh_path(train.sparkSession, "search"), study_name)
    return [Outcome(t.best, t.max_epochs(rules), t.losses, t.state, t.began, t.ended, None if t.best is not None else "no loss was a number")
            for t in trials]


REFUSED = (ValueError, ArithmeticError, IllegalArgumentException)  # settings that do not work; other errors are not the trial's


def search(
    study: Study, model: str, run: int, configs: Sequence[Mapping[str, Any]], metric: metrics.Metric | None = None,
    holdout_above: int = split.HOLDOUT_ABOVE, parallelism: int = 4, rules: running.Rules | None = None, path: str | None = None,
) -> DataFrame:
    """Trial log of one outer run: every configuration with its score and state.

    More than ``holdout_above`` training rows are searched on a hold-out, fewer
    on inner folds. A configuration that the model refuses, or whose numbers fail, is logged as FAIL
    with its message, and the search goes on; any other error ends it. Networks are
    searched under ``rules``, and go on from ``path`` if an earlier call with it was cut off.
    """
    family = FAMILIES[model]
    spark = study.rows.sparkSession
    train = scaled(study, family, run).filter(F.col("outer_fold") != run)
    strategy = "holdout" if train.count() > holdout_above else "cv"
    name = SEARCH_METRIC.get((model, strategy), "mse")
    metric_fn = metric or metrics.METRICS[name]
    if strategy == "holdout":
        train = split.with_holdout(train, study.key)
    objective, once = holdout_objective if strategy == "holdout" else cv_objective, Once()

    def one_trial(config: Mapping[str, Any]) -> Outcome:
        began = datetime.now(timezone.utc)
        try:
            if family.fit is fit_boosted and metric is None:
                out = boosted_objective(study, train, config, strategy)
            else:
                out = Outcome(float(objective(study, family, train, config, metric_fn, once)))
                out.message = family.altered(config) if family.altered else None
        except REFUSED as e:
            out = Outcome(None, state="FAIL", message=f"{type(e).__name__}: {e}"[:500])
        out.began, out.ended = began, datetime.now(timezone.utc)
        return out

    if family.learners is not None and metric is None:
        outcomes = running_search(study, family, train, configs, strategy, rules or running.Rules(NETWORK_EPOCHS), path, f"run{run}")
    else:
        outcomes = _at_once(spark, one_trial, list(configs), parallelism)
    rows = [
        (study.dataset_id, study.dataset_name, model, run, i, o.value, o.began, o.ended, {k: str(v) for k, v in config.items()},
         name if metric is None else "custom", o.epochs, o.losses, o.state, o.message)
        for i, (config, o) in enumerate(zip(configs, outcomes))
    ]
    return spark.createDataFrame(rows, TRIAL_SCHEMA)


# -- outer evaluation -----------------------------------------------------------------

def evaluate(
    study: Study, model: str, params_of_run: Mapping[int, Mapping[str, Any]], run_kind: str = "nested", parallelism: int = 5,
) -> tuple[DataFrame, DataFrame]:
    """Refit on each outer training part, predict its test part.

    Outer runs are independent: they are fitted in the same passes where the family
    can, else up to ``parallelism`` of them at the same time. Returns result rows (one per run, typed as the result log) and
    the predictions of all runs. Scores of all runs come from one plan.
    """
    family, _ = FAMILIES[model], study.stats
    spark = study.rows.sparkSession
    path = fresh_path(spark, "predictions")
    began = time.time()
    fitted = family.fit_runs(study, params_of_run) if family.fit_runs else {}
    shared = (time.time() - began) / len(params_of_run)  # a run's part of a joint fit

    def one_run(run: int) -> float:
        rows = scaled(study, family, run)
        began = time.time()
        predictor = fitted.get(run) or family.fit(rows.filter(F.col("outer_fold") != run), study, params_of_run[run])
        took = shared if run in fitted else time.time() - began
        test = predictor(rows.filter(F.col("outer_fold") == run), [*study.key, "outer_fold", "y"])
        unscaled(test, study, family, run).write.parquet(f"{path}/run={run}")
        return took

    runs = list(params_of_run)
    seconds = dict(zip(runs, _at_once(spark, one_run, runs, parallelism)))
    predictions = spark.read.parquet(path).drop("run")
    return result_rows(study, model, predictions, params_of_run, seconds, run_kind), predictions


def result_rows(study: Study, model: str, predictions: DataFrame, params_of_run, seconds, run_kind: str) -> DataFrame:
    var = "pred_var" if "pred_var" in predictions.columns else None
    scored = metrics.score(predictions, ["outer_fold"], var=var).collect()  # one row per run
    out = [
        (study.dataset_id, study.dataset_name, model, run_kind, s.outer_fold,
         {k: str(v) for k, v in params_of_run[s.outer_fold].items()},
         s.mse, s.mae, s.max_absolute_error, s.nll_score if var else None, seconds[s.outer_fold])
        for s in scored
    ]
    return predictions.sparkSession.createDataFrame(out, RESULT_SCHEMA)


def parse_params(params: Mapping[str, str]) -> dict[str, Any]:
    """Stored settings are text; numbers become numbers again."""
    def one(text: str) -> Any:
        for kind in (int, float):
            try:
                return kind(text)
            except ValueError:
                pass
        return {"True": True, "False": False, "None": None}.get(text, text)

    return {k: one(v) for k, v in params.items()}


def nested_study(
    study: Study, model: str, configs: Sequence[Mapping[str, Any]] | Callable[[int], Sequence[Mapping[str, Any]]],
    path: str | None = None, **options,
) -> tuple[DataFrame, DataFrame]:
    """Search, choose and evaluate every outer run: (trial log, result log).

    With ``path``, each run's trials and then its result are committed to logs
    there; a study that is called again with the same path takes finished parts from the logs.
    """
    _ = study.stats
    spark = study.rows.sparkSession
    trial_log = RunLog(spark, f"{path}/trials", TRIAL_SCHEMA) if path else None
    result_log = RunLog(spark, f"{path}/results") if path else None
    key = lambda run: f"{study.dataset_name}|{model}|{run}"

    def one_search(run: int) -> DataFrame:
        wanted = configs(run) if callable(configs) else configs
        if trial_log is None:
            return search(study, model, run, wanted, **options)
        if not trial_log.has(key(run)):
            trial_log.write(key(run), search(study, model, run, wanted, **{"path": f"{path}/running-{run}", **options}))
        return trial_log.read(key(run))

    runs = list(range(1, study.k_outer + 1))
    log = reduce(DataFrame.unionByName, _at_once(spark, one_search, runs, 2))
    best = best_trial(log, by=("outer_cv_split",)).select("outer_cv_split", "params", "max_epochs").collect()  # one row per run
    params = {b.outer_cv_split: refit_params(model, parse_params(b.params), b.max_epochs) for b in sorted(best)}
    if result_log is None:
        return log, evaluate(study, model, params)[0]
    open_runs = {run: p for run, p in params.items() if not result_log.has(key(run))}
    if open_runs:
        made = materialize(evaluate(study, model, open_runs)[0], "results")
        for run in open_runs:
            result_log.write(key(run), made.filter(F.col("outer_run") == run))
    return log, reduce(DataFrame.unionByName, [result_log.read(key(run)) for run in params])


def refit_params(model: str, params: dict[str, Any], epochs: int | None) -> dict[str, Any]:
    """Settings for the refit: the epochs or rounds that the search found best are its budget."""
    budget = FAMILIES[model].budget
    return params if budget is None or epochs is None else {**params, budget: max(1, epochs)}


def reevaluate(study: Study, model: str, results: DataFrame, extra: Mapping[str, Any] | None = None) -> DataFrame:
    """Fit the stored best configurations again on the same folds; new rows of kind ``reevaluated``."""
    stored = results.filter((F.col("model") == model) & (F.col("dataset_name") == study.dataset_name) & (F.col("run_kind") == "nested"))
    params = {r.outer_run: {**parse_params(r.params), **(extra or {})} for r in stored.select("outer_run", "params").collect()}
    return evaluate(study, model, dict(sorted(params.items())), "reevaluated")[0]


def full_data_run(df: DataFrame, key: Sequence[str], features: Sequence[str], dataset_name: str, model: str, params: Mapping[str, Any], dataset_id: int | None = None) -> DataFrame:
    """One stored configuration on a 75/25 split of a whole table."""
    family = FAMILIES[model]
    marked = split.with_holdout(df, key)
    rows = marked.select(*key, *[F.col(f"`{c}`").cast("double").alias(c) for c in features], F.col("y").cast("double").alias("y"),
                         F.when(F.col("is_test"), 1).otherwise(2).alias("outer_fold"),
                         F.array(F.lit(None).cast("int"), F.lit(None).cast("int")).alias("inner_folds"))
    # Two "folds": the test part is fold 1, so run 1 trains on the rest.
    study = Study(materialize(_spread(rows, key), "full", ["outer_fold"]), list(key), list(features), dataset_name, 2, 0, dataset_id)
    return evaluate(study, model, {1: params}, "full")[0]


def draw_configs(trials: DataFrame, names: Sequence[str], number: str = "number") -> list[dict[str, Any]]:
    """Settings of a drawn trial table, in trial order, for a search to loop over."""
    rows = trials.select(number, *names).collect()
    return [{n: r[n] for n in names if r[n] is not None} for r in sorted(rows, key=lambda r: r[number])]
