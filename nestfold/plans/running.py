"""A search that trains, stops, prunes, and can be killed and taken up again.

All trials that may run train in the same passes: one pass takes each of them an
epoch further on all its inner folds (a row trains the networks that leave out
other folds), a second one scores the left-out folds. A trial's report is the
average over its folds. After each round the rules decide:

* patience: as ``operators.trials.early_stopping`` replays it;
* time: the first report beyond the tolerance is the last; a pass counts in equal parts for its trials;
* NaN ends a trial; its best report before counts;
* hyperband: trials wait at their bracket's rungs until all others of the bracket are there or have ended,
  the best part goes on, the rest is PRUNED, as ``operators.trials.hyperband`` replays it;
* median: trials run one after the other and are compared with the COMPLETE ones before,
  as ``operators.trials.median_pruning`` replays it.

Reports and states go to a folder every ``save_every`` rounds, states first; a
round counts when its reports are there. A search with the same folder goes on
after the last round that counts; what was decided follows from the reports.
"""

from __future__ import annotations

import itertools
import time
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any, Callable, Mapping, Sequence

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from nestfold.models.net import Learner, Stopper, epoch_of, fold_errors
from nestfold.operators.trials import n_brackets, rungs

REPORTS = ("study string, number long, step long, pos long, value double, loss double, elapsed double, at timestamp, "
           "round long, saved long")
STATES = "study string, number long, learner int, state binary, steps long, round long"


@dataclass(frozen=True)
class Rules:
    """When trials end."""

    epochs: int
    patience: int = 10
    delta: float = 0.0
    tolerance: float | None = None  # seconds
    pruner: str | None = None  # "hyperband" or "median"
    min_resource: int = 1
    factor: int = 3
    startup: int = 5
    warmup: int = 20
    interval: int = 5
    at_once: int = 8  # trials in a pass
    save_every: int = 1  # rounds

    def __post_init__(self):
        if self.pruner not in (None, "hyperband", "median"):
            raise ValueError(f"no pruner {self.pruner!r}")


@dataclass
class Trial:
    """A configuration under way."""

    number: int
    config: Mapping[str, Any]
    learners: list[Learner]
    stopper: Stopper
    state: str = "RUNNING"
    values: list[float] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    elapsed: list[float] = field(default_factory=list)
    waiting: bool = False
    stopped_early: bool = False
    began: datetime | None = None
    ended: datetime | None = None

    @property
    def step(self) -> int:
        return len(self.values) - 1

    @property
    def best(self) -> float | None:
        return self.stopper.best

    def max_epochs(self, rules: Rules) -> int:
        """Epochs for the refit: all when the limit was reached, else up to the best one of the patience."""
        return rules.epochs if self.step == rules.epochs - 1 else max(1, self.step - rules.patience + 1)

    def report(self, value: float, loss: float, elapsed: float, rules: Rules) -> None:
        """Take a report and apply the rules that need no other trial."""
        self.values.append(value)
        self.losses.append(loss)
        self.elapsed.append(elapsed)
        if np.isnan(value):
            self.end("FAIL" if self.best is None else "COMPLETE")
        elif self.stopper.update(value, np.zeros(0)):
            self.end("COMPLETE")
        elif rules.tolerance is not None and elapsed > rules.tolerance:
            self.end("COMPLETE")

    def end(self, state: str) -> None:
        self.state, self.waiting, self.ended = state, False, datetime.now(timezone.utc)


def _at_rung(trial: Trial, rules: Rules) -> bool:
    bracket = trial.number % n_brackets(rules.min_resource, rules.epochs, rules.factor)
    return trial.step + 1 in rungs(rules.min_resource, rules.epochs, rules.factor, bracket)


def _judge_rungs(trials: Sequence[Trial], rules: Rules) -> None:
    """Decide every bracket whose running trials all wait at the same rung."""
    brackets = n_brackets(rules.min_resource, rules.epochs, rules.factor)
    for bracket in range(brackets):
        own = [t for t in trials if t.number % brackets == bracket]
        low = min((t.step for t in own if t.state == "RUNNING"), default=None)
        if low is None or any(t.state == "RUNNING" and not t.waiting for t in own):
            continue
        # Trials that ended with their report at this rung were among those compared.
        ranked = sorted((t for t in own if t.step == low and (t.waiting or t.state == "COMPLETE")), key=lambda t: (t.values[-1], t.number))
        keep = max(1, len(ranked) // rules.factor)
        for t in ranked:
            if t.waiting and t.values[-1] > ranked[keep - 1].values[-1]:
                t.end("PRUNED")
            t.waiting = False


def _judge_median(trial: Trial, trials: Sequence[Trial], rules: Rules) -> None:
    step = trial.step
    if trial.state != "RUNNING" or step < rules.warmup or (step - rules.warmup) % rules.interval:
        return
    complete = [t for t in trials if t.number < trial.number and t.state == "COMPLETE"]
    others = [t.values[step] for t in complete if t.step >= step]
    if len(complete) >= rules.startup and others and min(trial.values) > float(np.median(others)):
        trial.end("PRUNED")


def _decide(reported: Sequence[Trial], trials: Sequence[Trial], rules: Rules) -> None:
    if rules.pruner == "hyperband":
        for t in reported:
            t.waiting = t.state == "RUNNING" and _at_rung(t, rules)
        _judge_rungs(trials, rules)
    elif rules.pruner == "median":
        for t in reported:
            _judge_median(t, trials, rules)
    for t in trials:
        if t.state == "RUNNING" and not t.waiting and t.step == rules.epochs - 1:
            t.end("COMPLETE")


def _next(trials: Sequence[Trial], rules: Rules) -> list[Trial]:
    """Who trains in the next round: the furthest behind first; one after the other under the median rule."""
    ready = [t for t in trials if t.state == "RUNNING" and not t.waiting]
    if rules.pruner == "median":
        return ready[:1]
    return sorted(ready, key=lambda t: (t.step, t.number))[:rules.at_once]


class _Folder:
    """Reports and states of a search in the shared storage."""

    def __init__(self, spark: SparkSession, path: str, study: str):
        self.spark, self.path, self.study = spark, path, study

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").filter(F.col("study") == self.study)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def reports(self) -> DataFrame:
        """Each report once, also if two attempts wrote it."""
        return self._read("reports", REPORTS).dropDuplicates(["number", "step"])

    def save(self, round_: int, reports: list[tuple], trials: Sequence[Trial]) -> None:
        rows = [(self.study, t.number, i, one.state.tobytes(), one.steps, round_) for t in trials for i, one in enumerate(t.learners)]
        if rows:
            self.spark.createDataFrame(rows, STATES).write.mode("append").parquet(f"{self.path}/states")
        self.spark.createDataFrame([(self.study, *r, round_) for r in reports], REPORTS).coalesce(1).write.mode("append").parquet(f"{self.path}/reports")

    def restore(self, trials: Sequence[Trial], rules: Rules) -> int:
        """Take the trials to where the last saved round left them; gives the next round."""
        saved = sorted(self.reports().collect(), key=lambda r: (r["round"], r.number))
        if not saved:
            return 0
        of = {t.number: t for t in trials}
        # Replay round by round, so that every decision falls as it did.
        for _, group in itertools.groupby(saved, key=lambda r: r["round"]):
            same = list(group)
            for r in same:
                t = of[r.number]
                t.began = t.began or r["at"].astimezone(timezone.utc)
                t.report(r.value, r.loss, r.elapsed, rules)
            _decide([of[r.number] for r in same], trials, rules)
        last = {r.number: r for r in saved}
        for number, r in last.items():
            if of[number].state != "RUNNING":
                of[number].ended = r["at"].astimezone(timezone.utc)
        wanted = self.spark.createDataFrame(
            [(n, r.saved) for n, r in last.items() if of[n].state == "RUNNING"], "number long, round long")
        for row in self._read("states", STATES).join(wanted, ["number", "round"]).dropDuplicates(["number", "learner"]).collect():
            one = of[row.number].learners[row.learner]
            one.state, one.steps = np.frombuffer(row.state).copy(), row.steps
        return saved[-1]["round"] + 1


def run(
    rows: DataFrame, folds: Sequence[int], configs: Sequence[Mapping[str, Any]], learners: Callable[[Mapping[str, Any], int], list[Learner]],
    rules: Rules, path: str, study: str = "search", clock: Callable[[], float] = time.time,
    after_round: Callable[[int], None] | None = None,
) -> list[Trial]:
    """Search ``configs`` on ``rows`` (features, t, fold).

    ``learners(config, fold)`` makes the members of the ensemble that leaves out
    a fold. The folder ``path`` holds what a later call needs to go on;
    ``after_round`` is called with the number of each finished round.
    """
    spark = rows.sparkSession
    folder = _Folder(spark, path, study)
    trials = [Trial(i, c, [one for f in folds for one in learners(c, f)], Stopper(rules.patience, rules.delta)) for i, c in enumerate(configs)]
    round_, pending, touched = folder.restore(trials, rules), [], {}
    while some := _next(trials, rules):
        start = clock()
        for t in some:
            t.began = t.began or datetime.now(timezone.utc)
        every = [one for t in some for one in t.learners]
        losses = iter(epoch_of(rows, every, [t.step + 1 for t in some for _ in t.learners]))
        by_fold = [[one for one in t.learners if one.fold == f] for t in some for f in folds]
        errors = iter(fold_errors(rows, by_fold))
        took = (clock() - start) / len(some)
        for t in some:
            loss = float(np.mean([next(losses) for _ in t.learners]))
            value = float(np.mean([next(errors) for _ in folds]))
            before = t.elapsed[-1] if t.elapsed else 0.0
            t.report(float("nan") if np.isnan(loss) else value, loss, before + took, rules)
            pending.append((t.number, t.step, t.step, t.values[-1], loss, t.elapsed[-1], datetime.now(timezone.utc), round_))
            touched[t.number] = t
        _decide(some, trials, rules)
        if (round_ + 1) % rules.save_every == 0 or not _next(trials, rules):
            folder.save(round_, pending, [t for t in touched.values() if t.state == "RUNNING"])
            pending, touched = [], {}
        if after_round:
            after_round(round_)
        round_ += 1
    return trials


def reports(spark: SparkSession, path: str, study: str = "search") -> DataFrame:
    """All reports of a search, as the replay operators take them."""
    return _Folder(spark, path, study).reports().drop("round", "saved")
