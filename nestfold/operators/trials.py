"""Analytics over trial logs and report logs.

``reports(study, number, pos, step, value)`` holds the losses a trial reported;
``pos`` is the dense 0-based position of the report in its trial (the epoch).
``trials(study, number, value, state, ...)`` holds one row per trial.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from nestfold.operators.order import running, value_band
from nestfold.sources.storage import materialize

TRIAL = ("study", "number")


# -- cleaning and shaping of logs ------------------------------------------------

def clean_bool(column: Column) -> Column:
    """True/False from ``True``, ``1.0``, ``1`` and so on."""
    text = F.lower(F.trim(column.cast("string")))
    return F.when(text.isin("true", "1.0", "1"), True).when(text.isin("false", "0.0", "0"), False)


def clean_int(column: Column) -> Column:
    """Whole numbers stored as ``12.0``; an empty cell is null."""
    text = F.trim(column.cast("string"))
    return F.when(text != "", text).cast("double").cast("int")


def duration_seconds(column: Column) -> Column:
    """Seconds in text like ``0 days 00:03:52.923940``."""
    pattern = r"^(-?\d+) days? (\d+):(\d+):(\d+(?:\.\d+)?)$"
    part = lambda i: F.regexp_extract(column, pattern, i).cast("double")
    return F.when(column.rlike(pattern), part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4))


def stored_run(results: DataFrame, outer_run: int) -> DataFrame:
    """The stored result row of one outer run, by its number and not its position."""
    return results.filter(F.col("outer_run") == outer_run)


def flatten(trials: DataFrame, names: Sequence[str], params: str = "params", **constants) -> DataFrame:
    """Wide log: parameters as ``params_*`` columns, plus constant columns."""
    keep = [c for c in trials.columns if c != params]
    wide = trials.select(*keep, *[F.col(params)[n].alias(f"params_{n}") for n in names])
    return wide.withColumns({k: F.lit(v) for k, v in constants.items()})


# -- early stopping ---------------------------------------------------------------

_STATE = "struct<best:double,best_pos:bigint,best_step:bigint,stop_pos:bigint,stop_step:bigint,exit:bigint>"


def _state(**fields: Column) -> Column:
    parts = [
        fields.get(name, F.lit(None)).cast(kind).alias(name)
        for name, kind in (f.split(":") for f in _STATE[7:-1].split(","))
    ]
    return F.struct(*parts)


def _walk(rows: Column, entry: Column, end: Column, patience: int, delta: float) -> Column:
    """Follow the stopping rule from an accepted row at ``entry``.

    Ends with ``stop_pos`` (patience used up), with ``exit`` (the next accepted
    row lies beyond ``end``), or with neither (the trial ran out of reports).
    """
    def step(acc: Column, x: Column) -> Column:
        done = acc["stop_pos"].isNotNull() | acc["exit"].isNotNull() | (x["pos"] < entry)
        better = -x["value"] >= -acc["best"] + F.lit(delta)
        accept = acc["best"].isNull() | better
        taken = _state(best=x["value"], best_pos=x["pos"], best_step=x["step"])
        leave = _state(best=acc["best"], best_pos=acc["best_pos"], best_step=acc["best_step"], exit=x["pos"])
        stop = _state(best=acc["best"], best_pos=acc["best_pos"], best_step=acc["best_step"],
                      stop_pos=x["pos"], stop_step=x["step"])
        return (
            F.when(done, acc)
            .when(accept, F.when(x["pos"] > end, leave).otherwise(taken))
            .when(x["pos"] - acc["best_pos"] >= patience, stop)
            .otherwise(acc)
        )

    return F.reduce(rows, _state(), step)


def early_stopping(
    reports: DataFrame, patience: int, delta: float = 0.0, trial: Sequence[str] = TRIAL,
    value: str = "value", chunk: int = 4096,
) -> DataFrame:
    """Replay the stopping rule: best loss, where it was, and where the trial stops.

    A report is better when ``-loss >= -best + delta`` (ties count when delta is
    0); otherwise a counter grows, and the trial stops when it reaches
    ``patience``. ``stop_pos`` is null for a trial that ran to its end.

    The rule is sequential, but it can only ever look ``patience`` reports ahead:
    the next accepted report is at most that far away, or the trial stops. So
    each chunk of reports is summarised by what happens for each of the
    ``patience`` places at which it may be entered, and the summaries are linked.
    A trial with any number of reports is therefore handled in pieces of at most
    ``chunk + patience`` rows, in parallel, and linked in groups of ``chunk``.
    """
    trial = list(trial)
    own = F.floor(F.col("pos") / chunk)
    # The first rows of a chunk are also seen by the chunk before it.
    seen_by = F.when(
        (F.col("pos") % chunk < patience) & (F.col("pos") >= chunk), F.array(own, own - 1)
    ).otherwise(F.array(own))
    pieces = (
        reports.select(*trial, F.explode(seen_by).alias("_chunk"),
                       F.struct(F.col("pos").cast("long").alias("pos"), F.col("step").cast("long").alias("step"),
                                F.col(value).cast("double").alias("value")).alias("_r"))
        .groupBy(*trial, "_chunk").agg(F.array_sort(F.collect_list("_r")).alias("_rows"))
    )
    first = F.col("_chunk") * chunk
    end = first + chunk - 1
    # A chunk can be entered at its first `patience` rows; the first one only at 0.
    entries = F.when(F.col("_chunk") == 0, F.array(F.lit(0).cast("long"))).otherwise(
        F.sequence(first, first + patience - 1)
    )
    links = pieces.select(
        *trial, "_chunk",
        F.transform(entries, lambda e: F.struct(
            e.alias("entry"), _walk(F.col("_rows"), e, end, patience, delta).alias("state"))).alias("_links"),
    )
    # Link summaries: first in groups of `chunk`, then the groups of each trial.
    links = _link(links, trial, F.floor(F.col("_chunk") / chunk))
    final = _link(links, trial, F.lit(0).cast("long"))
    state = F.col("_links")[0]["state"]
    return final.select(
        *trial, state["best"].alias("best_value"), state["best_pos"].alias("best_pos"),
        state["best_step"].alias("best_step"), state["stop_pos"].alias("stop_pos"),
        state["stop_step"].alias("stop_step"),
    )


def _link(links: DataFrame, trial: Sequence[str], parent: Column) -> DataFrame:
    """Summaries of consecutive chunks become one summary of their span."""
    grouped = links.withColumn("_parent", parent).groupBy(*trial, "_parent").agg(
        F.array_sort(F.collect_list(F.struct("_chunk", "_links"))).alias("_span")
    )

    def follow(acc: Column, piece: Column) -> Column:
        hit = F.filter(piece["_links"], lambda link: link["entry"] == acc["exit"])
        return F.when(acc["exit"].isNull() | (F.size(hit) == 0), acc).otherwise(hit[0]["state"])

    rest = F.slice("_span", 2, F.greatest(F.size("_span") - 1, F.lit(0)))
    return grouped.select(
        *trial, F.col("_parent").alias("_chunk"),
        F.transform(F.col("_span")[0]["_links"], lambda link: F.struct(
            link["entry"].alias("entry"), F.reduce(rest, link["state"], follow).alias("state"))).alias("_links"),
    )


def early_stopping_with_best(
    reports: DataFrame, payload: Sequence[str], patience: int = 7, trial: Sequence[str] = TRIAL,
    value: str = "value",
) -> DataFrame:
    """Early stopping that also keeps the best report's payload (its checkpoint)."""
    stops = early_stopping(reports, patience, 0.0, trial, value)
    kept = reports.select(*trial, F.col("pos").cast("long").alias("best_pos"), *payload)
    return stops.join(kept, [*trial, "best_pos"], "left")


def epoch_budget(last_epoch: Column, limit: int, patience: int) -> Column:
    """Epochs for the refit: all if the limit was reached, else up to the best one."""
    return F.when(last_epoch == limit - 1, F.lit(limit)).otherwise(
        F.greatest(F.lit(1), last_epoch - patience + 1)
    ).cast("int")


def refit_budget(max_epochs: Column, factor: float) -> Column:
    return F.floor(max_epochs * factor).cast("int")


def time_budget(reports: DataFrame, tolerance: float, elapsed: str = "elapsed", trial: Sequence[str] = TRIAL,
                value: str = "value") -> DataFrame:
    """Best value of a trial that ends at its first report after ``tolerance`` seconds.

    Elapsed time grows with the step, so one aggregate does: everything within
    the budget, and the first report beyond it, which is still scored.
    """
    late = F.col(elapsed) > tolerance
    within = F.min(F.when(~late, F.col(value)))
    at_stop = F.min_by(value, F.when(late, F.col("step")))
    stop = F.min(F.when(late, F.col("step")))
    return reports.groupBy(*trial).agg(
        stop.alias("stop_step"),
        F.when(stop.isNull(), within).otherwise(F.least(within, at_stop)).alias("best_value"),
    )


def lockstep_average(reports: DataFrame, fold: str, n_folds: int, trial: Sequence[str] = TRIAL, value: str = "value") -> DataFrame:
    """Average the inner folds of each epoch; an epoch some fold did not finish is left out."""
    return (
        reports.groupBy(*trial, "step")
        .agg(F.avg(value).alias("value"), F.count(F.lit(1)).alias("_n"), F.countDistinct(fold).alias("_folds"))
        .filter(F.col("_folds") == n_folds).drop("_n", "_folds")
        .withColumn("pos", F.col("step"))
    )


# -- pruning -----------------------------------------------------------------------

def running_best(reports: DataFrame, trial: Sequence[str] = TRIAL, value: str = "value", chunk: int = 4096, out: str = "best_so_far") -> DataFrame:
    """Least value up to and including each report."""
    before = running(reports, trial, F.floor(F.col("pos") / chunk), ["pos"], minima={"_before": F.col(value)})
    return before.withColumn(out, F.least("_before", value)).drop("_before")


def median_pruning(
    reports: DataFrame, trials: DataFrame, startup: int = 5, warmup: int = 20, interval: int = 5,
) -> DataFrame:
    """First report at which the median rule prunes each trial, null if none.

    At every checked step the trial's best value so far is compared with the
    median of the values that COMPLETE trials with a lower number had there.

    Comparing each trial with all earlier ones would give n^2 pairs. Instead the
    earlier numbers are cut into blocks of 1, 2, 4, ... as in binary counting: a
    row looks into at most one block per power of two, and each value lies in
    one block per power. Within a block a running count in value order tells how
    many values are lower, and which are next to the trial's own; this settles
    the comparison with the median exactly.
    """
    study = ["study"]
    complete = F.col("state") == "COMPLETE"
    earlier = running(
        trials.select("study", "number", "state"), study, F.floor(F.col("number") / 1024), ["number"],
        sums={"_complete": F.when(complete, 1).otherwise(0).cast("long")},
    )
    best = running_best(reports.select("study", "number", "pos", "step", "value"))
    checks = best.filter((F.col("step") >= warmup) & ((F.col("step") - warmup) % interval == 0)).join(
        earlier, ["study", "number"]
    )
    checks = materialize(
        checks.select("study", "number", "step", "value", "best_so_far", "_complete",
                      (F.col("state") == "COMPLETE").alias("is_complete")), "median-checks")
    top = checks.agg(F.max("number").alias("m")).collect()[0].m or 0
    levels = F.explode(F.sequence(F.lit(0), F.lit(max(int(top).bit_length() - 1, 0))))
    shift = lambda level: F.floor(F.col("number") / F.pow(F.lit(2.0), level))
    values = (
        checks.filter("is_complete").select("study", "step", "number", F.col("value").alias("x"), levels.alias("level"))
        .withColumn("block", shift(F.col("level"))).filter(F.col("block") % 2 == 0)
        .select("study", "step", "level", "block", "x", F.lit(1).alias("is_value"), F.lit(None).cast("long").alias("number"))
    )
    queries = (
        checks.filter(F.col("_complete") >= startup)
        .select("study", "step", "number", F.col("best_so_far").alias("x"), levels.alias("level"))
        .withColumn("block", shift(F.col("level"))).filter(F.col("block") % 2 == 1)
        .select("study", "step", "level", (F.col("block") - 1).alias("block"), "x", F.lit(0).alias("is_value"), F.col("number").cast("long").alias("number"))
    )
    both = values.unionByName(queries)
    block = ["study", "step", "level", "block"]
    one = F.col("is_value").cast("long")
    value = F.when(F.col("is_value") == 1, F.col("x"))
    band = value_band(F.col("x"))
    # In rising order a query stands before equal values, so it counts lower ones only.
    lower = running(both, block, band, ["x", "is_value"], sums={"_lower": one}, maxima={"_under": value})
    # In falling order it stands behind them, so it sees the values not below it.
    upper = running(both, block, -band, [F.desc("x"), F.desc("is_value")], sums={"_upper": one}, minima={"_over": value})
    asked = ["study", "step", "number"]
    counted = (
        lower.filter("is_value = 0").select(*asked, "_lower", "_under", F.lit(0).cast("long").alias("_upper"), F.lit(None).cast("double").alias("_over"))
        .unionByName(upper.filter("is_value = 0").select(*asked, F.lit(0).cast("long").alias("_lower"), F.lit(None).cast("double").alias("_under"), "_upper", "_over"))
        .groupBy(*asked).agg(F.sum("_lower").alias("lower"), F.max("_under").alias("under"),
                             F.sum("_upper").alias("upper"), F.min("_over").alias("over"))
    )
    n = F.col("lower") + F.col("upper")
    # best > median: more than half lie lower; with exactly half, the midpoint decides.
    above_median = (2 * F.col("lower") > n) | (
        (2 * F.col("lower") == n) & (n > 0) & (F.col("best_so_far") > (F.col("under") + F.col("over")) / 2)
    )
    judged = checks.join(counted, asked, "left")
    return judged.groupBy("study", "number").agg(F.min(F.when(above_median, F.col("step"))).alias("pruned_step"))


def rungs(min_resource: int, max_resource: int, factor: int, bracket: int = 0) -> list[int]:
    """Epoch counts at which a bracket compares its trials."""
    out, r = [], min_resource * factor ** bracket
    while r <= max_resource:
        out.append(r)
        r *= factor
    return out


def n_brackets(min_resource: int, max_resource: int, factor: int) -> int:
    return len(rungs(min_resource, max_resource, factor))


def hyperband(
    reports: DataFrame, min_resource: int, max_resource: int, factor: int = 3, value_bands: int = 64,
) -> DataFrame:
    """Successive halving in brackets, replayed over complete reports.

    Trial ``number`` runs in bracket ``number mod brackets``. At each rung the
    trials still running there are ranked by their value, and the best
    ``max(1, n div factor)`` go on (ties with the last one too). Gives the rungs
    passed, and the step at which a trial was dropped, null if it never was.
    """
    brackets = n_brackets(min_resource, max_resource, factor)
    bracket = F.col("number") % brackets
    start = min_resource * F.pow(F.lit(float(factor)), bracket)
    members = reports.withColumn("bracket", bracket.cast("int"))
    last = members.groupBy("study", "number", "bracket").agg(F.max("step").alias("last_step"))
    resource = F.col("step") + 1
    at_rung = members.withColumn("rung", F.round(F.log(resource / start) / F.log(F.lit(float(factor)))).cast("int")).filter(
        (F.col("rung") >= 0) & (resource <= max_resource) & (F.pow(F.lit(float(factor)), F.col("rung")) * start == resource)
    ).select("study", "number", "bracket", "rung", "step", "value")
    at_rung = materialize(at_rung, "rungs")
    verdicts = None
    running_now = at_rung.filter("rung = 0")
    group = ["study", "bracket"]
    for rung in range(brackets):
        ranked = running(running_now, group, value_band(F.col("value"), value_bands), ["value", "number"],
                         sums={"_before": F.lit(1).cast("long")})
        sizes = running_now.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
        keep = F.greatest(F.lit(1), F.floor(F.col("_n") / factor))
        cut = ranked.join(sizes, group).filter(F.col("_before") == keep - 1).select(*group, F.col("value").alias("_cut"))
        judged = materialize(
            running_now.join(cut, group).withColumn("passed", F.col("value") <= F.col("_cut")).drop("_cut"),
            f"rung{rung}",
        )
        verdicts = judged if verdicts is None else verdicts.unionByName(judged)
        if rung + 1 < brackets:
            survivors = judged.filter("passed").select("study", "number")
            running_now = at_rung.filter(F.col("rung") == rung + 1).join(survivors, ["study", "number"], "left_semi")
    outcome = verdicts.groupBy("study", "number").agg(
        F.sum(F.col("passed").cast("int")).cast("int").alias("rungs_passed"),
        F.min(F.when(~F.col("passed"), F.col("step"))).alias("dropped_step"),
    )
    return last.join(outcome, ["study", "number"], "left").select(
        "study", "number", "bracket", F.coalesce("rungs_passed", F.lit(0)).alias("rungs_passed"), "dropped_step"
    )


# -- choosing ----------------------------------------------------------------------

def usable(trials: DataFrame) -> DataFrame:
    """Trials that can be best: complete, with a number as value."""
    return trials.filter((F.col("state") == "COMPLETE") & F.col("value").isNotNull() & ~F.isnan("value"))


def best_trial(trials: DataFrame, by: Sequence[str] = ("study",)) -> DataFrame:
    """Least value per study, ties to the lowest number; one aggregate, no window."""
    rest = [c for c in trials.columns if c not in (*by, "value", "number")]
    best = usable(trials).groupBy(*by).agg(F.min_by(
        F.struct("number", "value", *rest), F.struct("value", "number")).alias("b"))
    return best.select(*by, "b.*")


def end_at_nan(reports: DataFrame, trial: Sequence[str] = TRIAL, value: str = "value") -> DataFrame:
    """Per trial: the step of the first NaN loss (null if none) and the best value before it.

    A running minimum over the steps before the first NaN; the first NaN step
    comes from one aggregate, the rest from a join on the trial.
    """
    bad = F.isnan(value) | F.col(value).isNull()
    ends = reports.groupBy(*trial).agg(F.min(F.when(bad, F.col("step"))).alias("nan_step"))
    kept = reports.join(ends, list(trial)).filter(F.col("nan_step").isNull() | (F.col("step") < F.col("nan_step")))
    best = kept.groupBy(*trial).agg(F.min(value).alias("best_value"))
    return ends.join(best, list(trial), "left")


def state_counts(trials: DataFrame, by: Sequence[str] = ("study",)) -> DataFrame:
    """Trials per state, and how many of them can be best."""
    ok = (F.col("state") == "COMPLETE") & F.col("value").isNotNull() & ~F.isnan(F.coalesce("value", F.lit(float("nan"))))
    return trials.groupBy(*by, "state").agg(
        F.count(F.lit(1)).alias("trials"), F.sum(F.when(ok, 1).otherwise(0)).alias("usable")
    )
