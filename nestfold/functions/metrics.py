"""Scores as aggregate columns: ``metric(prediction, truth[, variance])``.

Each is one pass with a map-side combine, so any grouping is safe under skew.
"""

from __future__ import annotations

import math
from typing import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

VARIANCE_FLOOR = 1e-6

Metric = Callable[[Column, Column], Column]


def mse(pred: Column, y: Column) -> Column:
    return F.avg((pred - y) * (pred - y))


def mae(pred: Column, y: Column) -> Column:
    return F.avg(F.abs(pred - y))


def max_absolute_error(pred: Column, y: Column) -> Column:
    return F.max(F.abs(pred - y))


def negated(metric: Metric) -> Metric:
    """For searches that maximise."""
    return lambda pred, y: -metric(pred, y)


def rmse(pred: Column, y: Column) -> Column:
    return F.sqrt(mse(pred, y))


def floor_variance(var: Column, floor: float = VARIANCE_FLOOR) -> Column:
    """Variances that are zero or negative become the floor; others stay."""
    return F.when(var > 0, var).otherwise(F.lit(floor))


def gaussian_nll_row(mean: Column, y: Column, var: Column) -> Column:
    """Row term, without the constant; the variance is at least the floor."""
    v = F.greatest(var, F.lit(VARIANCE_FLOOR))
    return 0.5 * (F.log(v) + (mean - y) * (mean - y) / v)


def gaussian_nll(mean: Column, y: Column, var: Column) -> Column:
    return F.avg(gaussian_nll_row(mean, y, var))


def log_marginal(mean: Column, y: Column, var: Column) -> Column:
    """log N(y; mean, var) with the constant."""
    return -0.5 * (F.log(F.lit(2 * math.pi) * var) + (y - mean) * (y - mean) / var)


METRICS: dict[str, Metric] = {
    "mse": mse, "mae": mae, "max_absolute_error": max_absolute_error, "rmse": rmse,
    "neg_mse": negated(mse),
}


def score(df: DataFrame, by: Sequence[str], metrics: Mapping[str, Metric] | Sequence[str] = ("mse", "mae", "max_absolute_error"),
          pred: str = "pred_mean", y: str = "y", var: str | None = None) -> DataFrame:
    """Scores per group; ``var`` adds the Gaussian NLL as ``nll_score``."""
    if not isinstance(metrics, Mapping):
        metrics = {name: METRICS[name] for name in metrics}
    aggs = [m(F.col(pred), F.col(y)).alias(name) for name, m in metrics.items()]
    if var:
        aggs.append(gaussian_nll(F.col(pred), F.col(y), F.col(var)).alias("nll_score"))
    return df.groupBy(*by).agg(*aggs)


def macro_mean(scores: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean of group scores, each group counting the same."""
    return scores.groupBy(*by).agg(*[F.avg(c).alias(c) for c in columns])


def epoch_loss(df: DataFrame, by: Sequence[str], batch: str, loss: str, out: str = "epoch_loss") -> DataFrame:
    """Mean of batch means: a short last batch counts like the others."""
    per_batch = df.groupBy(*by, batch).agg(F.avg(loss).alias("_batch_loss"))
    return per_batch.groupBy(*by).agg(F.avg("_batch_loss").alias(out))


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from one stamp to another, whatever the session's time zone."""
    gap = end - start
    return (
        F.extract(F.lit("DAY"), gap) * 86400.0 + F.extract(F.lit("HOUR"), gap) * 3600.0
        + F.extract(F.lit("MINUTE"), gap) * 60.0 + F.extract(F.lit("SECOND"), gap).cast("double")
    )
