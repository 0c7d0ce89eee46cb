"""Trial tables drawn from search spaces, as plain column expressions.

Trial ``number`` and a seed fix every parameter, so a trial table of any length
can be drawn in parallel, and drawn again after a failure.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Any, Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from nestfold.functions.keys import uniform


@dataclass(frozen=True)
class Int:
    low: int
    high: int
    log: bool = False

    def draw(self, u: Column) -> Column:
        if not self.log:
            return (F.lit(self.low) + F.floor(u * (self.high - self.low + 1))).cast("int")
        lo, hi = math.log(self.low - 0.5), math.log(self.high + 0.5)
        value = F.round(F.exp(F.lit(lo) + u * F.lit(hi - lo)))
        return F.least(F.lit(self.high), F.greatest(F.lit(self.low), value.cast("int")))


@dataclass(frozen=True)
class Float:
    low: float
    high: float
    log: bool = False

    def draw(self, u: Column) -> Column:
        if not self.log:
            return F.lit(self.low) + u * F.lit(self.high - self.low)
        lo, hi = math.log(self.low), math.log(self.high)
        return F.exp(F.lit(lo) + u * F.lit(hi - lo))


@dataclass(frozen=True)
class Choice:
    options: tuple

    def draw(self, u: Column) -> Column:
        return F.array(*map(F.lit, self.options))[F.floor(u * len(self.options)).cast("int")]


@dataclass(frozen=True)
class Branch:
    """A parameter whose range depends on parameters drawn before it.

    ``cases`` are (condition on earlier parameters, distribution); where none
    holds, the parameter is null: it is not part of that trial.
    """

    cases: tuple[tuple[Callable[[], Column], Any], ...]

    def draw(self, u: Column) -> Column:
        out = None
        for condition, dist in self.cases:
            out = F.when(condition(), dist.draw(u)) if out is None else out.when(condition(), dist.draw(u))
        return out


@dataclass(frozen=True)
class Space:
    params: Mapping[str, Any]
    holdout: Mapping[str, Any] = field(default_factory=dict)
    default: Mapping[str, Any] | None = None

    def form(self, holdout: bool) -> dict[str, Any]:
        return {**self.params, **self.holdout} if holdout else dict(self.params)


def _is(name: str, value: Any) -> Callable[[], Column]:
    return lambda: F.col(name) == value


def _at_most(name: str, value: Any) -> Callable[[], Column]:
    return lambda: F.col(name) <= value


def _always() -> Column:
    return F.lit(True)


# Search ranges, hold-out differences and first configurations of
# the eight studies.
SPACES: dict[str, Space] = {
    "RF": Space(
        {"n_estimators": Int(10, 500, log=True), "max_depth": Int(5, 100, log=True),
         "min_samples_split": Int(2, 25), "min_samples_leaf": Int(1, 25),
         "max_features": Choice(("sqrt", "auto"))},
        {"n_estimators": Int(10, 250, log=True), "max_depth": Int(5, 50, log=True),
         "min_samples_split": Int(2, 15), "min_samples_leaf": Int(1, 15)},
    ),
    "XGB": Space(
        {"max_depth": Int(4, 75), "learning_rate": Float(0.001, 0.1, log=True),
         "colsample_bytree": Float(0.2, 0.6, log=True), "subsample": Float(0.4, 0.8, log=True),
         "reg_alpha": Float(0.01, 10.0, log=True), "reg_lambda": Float(1e-8, 10.0, log=True),
         "gamma": Float(1e-8, 10.0, log=True), "min_child_weight": Float(2, 100, log=True)},
        {"max_depth": Int(4, 50)},
        {"max_depth": 46, "learning_rate": 0.05518, "colsample_bytree": 0.59548, "subsample": 0.630578,
         "reg_alpha": 1.465652, "reg_lambda": 2.7e-08, "gamma": 2.57e-05, "min_child_weight": 63.056},
    ),
    "DE": Space(
        {"lr": Float(1e-5, 1e-1, log=True), "n_max": Int(20, 1024), "n_layers": Int(2, 6),
         "batch_size": Choice((512, 1024, 2048, 4096, 8124))},
        {}, {"n_max": 200, "n_layers": 4, "lr": 0.001, "batch_size": 512},
    ),
    "DKL": Space(
        {"n_max": Int(64, 1024), "n_layers": Int(2, 5), "n_out": Int(2, 4), "p": Float(0.0, 0.0),
         "mean_type": Choice(("constant", "linear")),
         "kernel_type": Choice(("rbf", "matern0.5", "matern1.5", "spectral")),
         "num_mixtures": Branch(((_is("kernel_type", "spectral"), Int(2, 8)),)),
         "lr": Float(1e-4, 1e-1, log=True),
         "grid_size": Branch(((_at_most("n_out", 2), Int(10, 400)), (_is("n_out", 3), Int(10, 50)),
                              (_always, Int(10, 20)))),
         "initialize_fe": Choice((True, False))},
        {"n_out": Int(2, 2), "grid_size": Int(10, 300)},
        {"n_max": 1024, "n_layers": 4, "n_out": 2, "mean_type": "constant", "kernel_type": "rbf",
         "lr": 0.01, "grid_size": 300, "initialize_fe": False},
    ),
    "VDKL": Space(
        {"n_max": Int(64, 1024), "n_layers": Int(2, 5), "n_out": Int(2, 20),
         "mean_type": Choice(("constant", "linear")),
         "kernel_type": Choice(("rbf", "matern0.5", "matern1.5")),
         "lr": Float(1e-4, 1e-1, log=True), "batch_size": Choice((512, 1024, 2048)),
         "num_inducing": Int(50, 2000, log=True), "initialize_fe": Choice((True, False)),
         "minit": Choice(("random", "kmeans"))},
        {"lr": Float(1e-6, 1e-1, log=True), "batch_size": Choice((1024, 2048, 8192))},
        {"n_max": 1024, "n_layers": 4, "n_out": 8, "mean_type": "constant", "kernel_type": "rbf",
         "lr": 0.01, "num_inducing": 1000, "initialize_fe": False},
    ),
    "DGP": Space(
        {"lr": Float(1e-4, 1e-1, log=True), "kernel_type": Choice(("rbf", "matern0.5", "matern1.5")),
         "batch_size": Choice((256, 512, 1024)), "num_inducing": Int(50, 1000, log=True),
         "num_samples": Int(2, 15), "n_gp_layers": Int(1, 5, log=True), "n_gp_out": Int(1, 4, log=True)},
        {"batch_size": Choice((512, 1024, 2048)), "num_inducing": Int(50, 800, log=True),
         "n_gp_layers": Int(1, 4, log=True)},
        {"n_gp_layers": 2, "n_gp_out": 1, "num_inducing": 200, "batch_size": 1024, "lr": 0.001,
         "num_samples": 10, "kernel_type": "rbf"},
    ),
    "NNDGP": Space(
        {"n_max": Int(64, 1024), "n_layers": Int(2, 5), "n_out": Int(2, 20, log=True),
         "initialize_fe": Choice((True, False)), "lr": Float(1e-4, 1e-1, log=True),
         "batch_size": Choice((256, 512, 1024)), "num_inducing": Int(50, 800, log=True),
         "num_samples": Int(2, 15), "n_gp_layers": Int(1, 5, log=True), "n_gp_out": Int(1, 4, log=True)},
        {"n_layers": Int(2, 4), "batch_size": Choice((512, 1024, 2048)), "num_samples": Int(2, 12),
         "n_gp_layers": Int(1, 4, log=True), "n_gp_out": Int(1, 3, log=True)},
        {"n_max": 1024, "n_layers": 4, "n_out": 2, "n_gp_layers": 2, "n_gp_out": 1, "num_inducing": 200,
         "batch_size": 1024, "lr": 0.001, "num_samples": 10},
    ),
    "DSPP": Space(
        {"lr": Float(1e-4, 1e-1, log=True), "batch_size": Choice((256, 512, 1024)),
         "num_inducing": Int(50, 800, log=True), "num_quadrature_sites": Int(5, 10),
         "beta": Choice((0.01, 0.05, 0.2, 1.0)), "n_dspp_layers": Int(1, 4, log=True),
         "n_dspp_out": Int(1, 5, log=True)},
        {"batch_size": Choice((512, 1024, 2048)), "n_dspp_layers": Int(1, 3, log=True),
         "n_dspp_out": Int(1, 4, log=True)},
        {"n_dspp_layers": 3, "n_dspp_out": 1, "num_inducing": 200, "batch_size": 1024, "lr": 0.001,
         "num_quadrature_sites": 8, "beta": 0.05},
    ),
}


def draw_trials(numbers: DataFrame, space: Space | str, seed: int | str, number: str = "number", holdout: bool = False) -> DataFrame:
    """Add one column per parameter to a table of trial numbers."""
    space = SPACES[space] if isinstance(space, str) else space
    for name, dist in space.form(holdout).items():
        numbers = numbers.withColumn(name, dist.draw(uniform(seed, F.lit(name), number)))
    return numbers


def with_defaults(trials: DataFrame, defaults: Sequence[Mapping[str, Any]], number: str = "number") -> DataFrame:
    """Replace the first trials (0, 1, ...) by given configurations.

    Parameters a configuration leaves out keep their drawn value.
    """
    types = dict(trials.dtypes)
    for i, config in enumerate(defaults):
        trials = trials.withColumns({
            name: F.when(F.col(number) == i, F.lit(value).cast(types[name])).otherwise(F.col(name))
            for name, value in config.items()
        })
    return trials
