"""Combining predictive distributions: one row per (row id, component)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

BAND = 256.0  # exponent width of one band; exp(256) summed over 1e190 rows is still finite


def equal_mixture(df: DataFrame, row: Sequence[str], mean: str = "mean", var: str = "var") -> DataFrame:
    """Moments of the equal-weight mixture (law of total variance)."""
    m, v = F.col(mean), F.col(var)
    return df.groupBy(*row).agg(
        F.avg(m).alias("pred_mean"), (F.avg(v + m * m) - F.avg(m) * F.avg(m)).alias("pred_var")
    )


def weighted_mixture(df: DataFrame, row: Sequence[str], log_weight: str = "log_weight", mean: str = "mean", var: str = "var") -> DataFrame:
    """Moments of a weighted mixture; weights are exp(log_weight) as given."""
    w, m, v = F.exp(F.col(log_weight)), F.col(mean), F.col(var)
    first = F.sum(w * m)
    return df.groupBy(*row).agg(first.alias("pred_mean"), (F.sum(w * (v + m * m)) - first * first).alias("pred_var"))


def attach_weights(components: DataFrame, weights: DataFrame, component: str = "component") -> DataFrame:
    """Join the table of component weights; AQE broadcasts it when it is small."""
    return components.join(weights, component)


def sample_average(df: DataFrame, row: Sequence[str], mean: str = "mean", var: str = "var") -> DataFrame:
    """Mean of means and plain mean of variances."""
    return df.groupBy(*row).agg(F.avg(mean).alias("pred_mean"), F.avg(var).alias("pred_var"))


def log_sum_exp(df: DataFrame, row: Sequence[str], term: Column, out: str = "log_density") -> DataFrame:
    """log(sum(exp(term))) per row id, without overflow.

    Terms are summed within bands of exponents first. That is a plain sum with a
    map-side combine, so a row id with very many components is no problem; only
    a few band sums per row id are left to be brought to the largest band.
    """
    rows = list(row)
    banded = df.select(*rows, term.alias("_l")).withColumn("_band", F.floor(F.col("_l") / BAND))
    sums = banded.groupBy(*rows, "_band").agg(F.sum(F.exp(F.col("_l") - F.col("_band") * BAND)).alias("_s"))
    top = F.max("_band").over(Window.partitionBy(*rows))
    return (
        sums.withColumn("_top", top)
        .groupBy(*rows, "_top")
        .agg(F.sum(F.col("_s") * F.exp((F.col("_band") - F.col("_top")) * BAND)).alias("_s"))
        .select(*rows, (F.col("_top") * BAND + F.log("_s")).alias(out))
    )


def mixture_log_density(df: DataFrame, row: Sequence[str], y: str = "y", log_weight: str = "log_weight", mean: str = "mean", var: str = "var") -> DataFrame:
    """Log density of ``y`` under the weighted mixture, per row id."""
    from nestfold.functions.metrics import log_marginal

    term = F.col(log_weight) + log_marginal(F.col(mean), F.col(y), F.col(var))
    return log_sum_exp(df, row, term)
