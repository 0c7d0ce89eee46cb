"""Scalers fitted per fold on the training rows only.

One pass gives partial statistics per fold; "all folds but f" is merged from
those k rows. The data is read once for all k scalers, and never copied.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def fold_partials(df: DataFrame, columns: Sequence[str], fold: str = "fold") -> DataFrame:
    """Long form, one row per (fold, column): rows, min, max, mean, squared deviations.

    All columns are aggregated in one pass; only the few results are unfolded.
    """
    aggs = [F.count(F.lit(1)).cast("double").alias("n")]
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`").cast("double")
        aggs.append(F.struct(
            F.lit(i).alias("at"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"),
            (F.var_pop(x) * F.count(F.lit(1))).alias("m2"),
        ).alias(f"_{i}"))
    wide = df.groupBy(fold).agg(*aggs)
    cells = F.explode(F.array(*[f"_{i}" for i in range(len(columns))]))
    return wide.select(fold, "n", cells.alias("c")).select(fold, "n", "c.*")


def _merge(a: Column, b: Column) -> Column:
    """Pooled (n, min, max, mean, m2) of two disjoint sets."""
    n = a["n"] + b["n"]
    d = b["mean"] - a["mean"]
    return F.struct(
        n.alias("n"), F.least(a["min"], b["min"]).alias("min"), F.greatest(a["max"], b["max"]).alias("max"),
        (a["mean"] + d * b["n"] / n).alias("mean"),
        (a["m2"] + b["m2"] + d * d * a["n"] * b["n"] / n).alias("m2"),
    )


def train_stats(partials: DataFrame, fold: str = "fold") -> DataFrame:
    """Long form, one row per (outer run, column): statistics of its training part.

    A zero range or standard deviation is given as 1, so that division leaves zeros.
    """
    fields = ("n", "min", "max", "mean", "m2")
    merged = (
        partials.groupBy("at").agg(F.array_sort(F.collect_list(F.struct(fold, *fields))).alias("parts"))
        .select("at", "parts", F.explode(f"parts.{fold}").alias(fold))
        .withColumn("rest", F.transform(F.filter("parts", lambda p: p[fold] != F.col(fold)),
                                        lambda p: F.struct(*[p[f].alias(f) for f in fields])))
        .filter(F.size("rest") > 0)
        .select(fold, "at", F.reduce(F.slice("rest", 2, F.size("rest")), F.col("rest")[0], _merge).alias("s"))
        .select(fold, "at", "s.*")
    )
    width, std = F.col("max") - F.col("min"), F.sqrt(F.col("m2") / F.col("n"))
    return merged.select(
        fold, "at", "n", "min", "max", F.when(width == 0, 1.0).otherwise(width).alias("range"), "mean",
        F.when(std == 0, 1.0).otherwise(std).alias("std"),
    )


@dataclass(frozen=True)
class Scaler:
    """Training statistics of every outer run: one row per run, one struct per column.

    The table has as many rows as there are folds, whatever the data's size.
    """

    table: DataFrame
    columns: tuple[str, ...]
    fold: str = "fold"

    def stat(self, column: str) -> Column:
        """The struct (n, min, max, range, mean, std) of a column, after ``attach``."""
        return F.col("_s")[self.columns.index(column)]

    def attach(self, df: DataFrame, run: int | None = None) -> DataFrame:
        """Put the statistics next to the rows.

        Without ``run`` every row gets those of its own fold: it is a test row
        there. With ``run`` all rows get the statistics of that outer run, so the
        rows of other folds are its training rows.
        """
        packed = self.table.select(F.col(self.fold).alias("_fold"), F.col("stats").alias("_s"))
        key = F.col(self.fold)
        if run is not None:
            df, packed, key = df.withColumn("_run", F.lit(run)), packed.filter(F.col("_fold") == run), F.col("_run")
        return df.join(F.broadcast(packed), key == F.col("_fold")).drop("_fold", "_run")

    def constants(self) -> dict[int, dict[str, dict[str, float]]]:
        """All statistics as plain numbers, by run, column and field.

        For plans that serve one run: they need no join, and are scanned often.
        """
        return {
            row[self.fold]: {c: s.asDict() for c, s in zip(self.columns, row["stats"])}
            for row in self.table.collect()  # k rows
        }


def fit(df: DataFrame, columns: Sequence[str], fold: str = "fold") -> Scaler:
    stats = train_stats(fold_partials(df, columns, fold), fold)
    cells = F.array_sort(F.collect_list(F.struct("at", "n", "min", "max", "range", "mean", "std")))
    return Scaler(stats.groupBy(fold).agg(cells.alias("stats")), tuple(columns), fold)


# A statistic is a struct column next to the row, or a dictionary of numbers.
Stat = Column | Mapping[str, float]


def minmax(value: Column, stat: Stat) -> Column:
    return (value - stat["min"]) / stat["range"]


def minmax_inverse(value: Column, stat: Stat) -> Column:
    return value * stat["range"] + stat["min"]


def standardize(value: Column, stat: Stat) -> Column:
    return (value - stat["mean"]) / stat["std"]


def rescale_variance(var: Column, stat: Stat) -> Column:
    """Variance of the target in its own units."""
    return var * stat["range"] * stat["range"]


def apply(df: DataFrame, scaler: Scaler, columns: Sequence[str], how: str = "minmax", run: int | None = None) -> DataFrame:
    """Scale ``columns`` in place; values outside the training range are kept as they fall."""
    op = {"minmax": minmax, "standard": standardize}[how]
    return scaler.attach(df, run).withColumns({
        c: op(F.col(f"`{c}`").cast("double"), scaler.stat(c)) for c in columns
    }).drop("_s")


def array_bounds(df: DataFrame, vector: str, by: Sequence[str] = ()) -> DataFrame:
    """Per-element minimum and maximum of an array column, as two arrays.

    Elements are unfolded and aggregated map-side, so only (groups x length)
    partial rows are shuffled.
    """
    per_dim = (
        df.select(*by, F.posexplode(vector).alias("dim", "x"))
        .groupBy(*by, "dim").agg(F.min(F.col("x").cast("double")).alias("lo"), F.max(F.col("x").cast("double")).alias("hi"))
    )
    cells = F.array_sort(F.collect_list(F.struct("dim", "lo", "hi")))
    return per_dim.groupBy(*by).agg(cells.alias("_c")).select(
        *by, F.col("_c.lo").alias("lo"), F.col("_c.hi").alias("hi")
    )


def scale_to_bounds(vector: Column, lo: Column, hi: Column, lower: float = 0.0, upper: float = 1.0) -> Column:
    """Elements moved into [lower, upper] by training bounds, clamped outside."""
    spans = F.arrays_zip(vector.alias("x"), lo.alias("lo"), hi.alias("hi"))
    def one(c: Column) -> Column:
        width = F.when(c["hi"] == c["lo"], 1.0).otherwise(c["hi"] - c["lo"])
        unit = F.least(F.greatest((c["x"].cast("double") - c["lo"]) / width, F.lit(0.0)), F.lit(1.0))
        return unit * (upper - lower) + lower
    return F.transform(spans, one)
