"""Folds, hold-outs, samples and batches in reproducible random order.

Fold sizes are those of a shuffled K-fold: they differ by one at most, the
first ``n mod k`` folds having one row more.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from nestfold.functions.keys import order_hash
from nestfold.operators.order import above, find_cuts, with_rank

# Seeds of the outer and inner folds, hold-out share, and the
# number of training rows beyond which the search uses a hold-out.
OUTER_SEED = 73
INNER_SEED = 69
HOLDOUT_FRACTION = 0.25
HOLDOUT_ABOVE = 100_000


def _fold_ends(k: int):
    """Last rank of each fold but the last, from the number of rows."""
    return lambda n: F.transform(
        F.sequence(F.lit(1), F.lit(k - 1)),
        lambda i: i * F.floor(n / k) + F.least(i.cast("long"), n % k),
    )


def with_kfold(
    df: DataFrame, key: Sequence[str], k: int = 5, seed: int = OUTER_SEED, out: str = "fold",
    keys_from: DataFrame | None = None,
) -> DataFrame:
    """Fold 1..k for every row.

    ``keys_from`` may name a cheaper table with the same keys (the fact table
    before a join, say) to take the cuts from.
    """
    h = order_hash(seed, *key)
    cuts = find_cuts(keys_from if keys_from is not None else df, h, _fold_ends(k))
    return df.withColumn("_h", h).withColumn(out, above(F.col("_h"), cuts.get(0, [])) + 1).drop("_h")


def with_nested_folds(
    df: DataFrame, key: Sequence[str], k_outer: int = 5, k_inner: int = 4,
    outer_seed: int = OUTER_SEED, inner_seed: int = INNER_SEED, outer: str = "outer_fold",
    inner: str = "inner_folds",
) -> DataFrame:
    """Outer fold, and an array with the inner fold in each outer training part.

    Element f-1 is the inner fold for outer run f, null where the row is test
    data of that run. The rows are neither shuffled nor copied: the inner cuts
    of all runs come from one count per (hash prefix, outer fold).
    """
    folded = with_kfold(df, key, k_outer, outer_seed, outer)
    h = order_hash(inner_seed, *key)
    # The runs a row trains in, looked up by its outer fold.
    all_runs = range(1, k_outer + 1)
    runs = F.element_at(F.lit([[f for f in all_runs if f != own] for own in all_runs]), F.col(outer))
    cuts = find_cuts(folded, h, _fold_ends(k_inner), scopes=runs)
    # The hash is a column of its own, so that it is computed once per row.
    per_run = [F.when(F.col(outer) != f, above(F.col("_h"), cuts.get(f, [])) + 1) for f in all_runs]
    return folded.withColumn("_h", h).withColumn(inner, F.array(*per_run)).drop("_h")


def nested_roles(df: DataFrame, outer: str = "outer_fold", inner: str = "inner_folds") -> DataFrame:
    """Long form: one row per outer run with role ``train`` or ``test``."""
    others = [c for c in df.columns if c not in (outer, inner)]
    # The outer form: for the plain one the optimizer adds a filter on the array's
    # size, which would compute all folds a second time below the explode.
    return df.select(
        *others, F.col(outer).alias("_own"), F.posexplode_outer(inner).alias("_i", "inner_fold")
    ).select(
        *others, (F.col("_i") + 1).alias("outer_run"),
        F.when(F.col("_own") == F.col("_i") + 1, "test").otherwise("train").alias("role"), "inner_fold",
    )


def sample_exact(df: DataFrame, key: Sequence[str], n: int, seed: int = OUTER_SEED) -> DataFrame:
    """Exactly ``n`` rows without replacement (all rows if there are fewer)."""
    h = order_hash(seed, *key)
    cuts = find_cuts(df, h, lambda total: F.array(F.least(F.lit(n).cast("long"), total)))
    return df.filter(h <= F.lit(cuts[0][0])) if cuts else df


def with_holdout(
    df: DataFrame, key: Sequence[str], fraction: float = HOLDOUT_FRACTION, seed: int = OUTER_SEED,
    out: str = "is_test", scope: Column | None = None,
) -> DataFrame:
    """Mark ``ceil(fraction * n)`` rows as test rows.

    With ``scope`` (a condition) only those rows take part, the rest is null.
    """
    h = order_hash(seed, *key)
    rows = df if scope is None else df.filter(scope)
    cuts = find_cuts(rows, h, lambda n: F.array(F.ceil(F.lit(fraction) * n)))
    mark = h <= F.lit(cuts[0][0] if cuts else "")
    return df.withColumn(out, mark if scope is None else F.when(scope, mark))


def search_strategy(
    df: DataFrame, fold: str = "outer_fold", above_rows: int = HOLDOUT_ABOVE
) -> DataFrame:
    """Per outer run: training rows, and whether the search uses CV or a hold-out.

    Counts per fold (k rows) are handed to the other runs, not the data.
    """
    sizes = df.groupBy(fold).agg(F.count(F.lit(1)).alias("n"))
    runs = sizes.agg(F.sum("n").alias("total"), F.collect_list(F.struct(fold, "n")).alias("own"))
    return runs.select("total", F.explode("own").alias("o")).select(
        F.col(f"o.{fold}").alias("outer_run"), (F.col("total") - F.col("o.n")).alias("train_rows")
    ).withColumn("strategy", F.when(F.col("train_rows") > above_rows, "holdout").otherwise("cv"))


def take_rows(df: DataFrame, ids: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.join(ids, list(key), "left_semi")


def drop_rows(df: DataFrame, ids: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.join(ids, list(key), "left_anti")


def with_batches(
    df: DataFrame, key: Sequence[str], size: int, epoch: int | None = None, out: str = "batch"
) -> DataFrame:
    """Batch number 0.. of each row; the last batch may be short.

    Rows are shuffled anew for each ``epoch``; without one they are in key-hash
    order for scoring, where the order does not matter.
    """
    seed = "score" if epoch is None else f"epoch{epoch}"
    ranked = with_rank(df, order_hash(seed, *key), "_rank")
    return ranked.withColumn(out, F.floor((F.col("_rank") - 1) / size)).drop("_rank")
