"""Input tables: declared specs, a registry, and readers."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructType


@dataclass(frozen=True)
class TableSpec:
    """What a benchmark needs to know about a table.

    ``key`` names columns that identify a row; folds and samples are drawn in
    hash order of it. ``targets`` maps a target's short name to its column.
    """

    name: str
    features: tuple[str, ...]
    targets: dict[str, str]
    key: tuple[str, ...]
    path: str | None = None
    default_target: str | None = None

    def target(self, which: str | None = None) -> str:
        which = which or self.default_target or next(iter(self.targets))
        return self.targets[which]

    def dataset_name(self, which: str | None = None) -> str:
        """Name used in logs; the target is part of it when there are several."""
        if len(self.targets) == 1:
            return self.name
        return f"{self.name}_{which or self.default_target or next(iter(self.targets))}"


# Catalogue numbers and names of the public study tables.
CATALOGUE = {
    216: "elevators",
    287: "wine_quality",
    4549: "buzz",
    42225: "diamonds",
    44027: "year",
}


class Registry:
    """Named tables on Parquet; ``load`` returns features, target and flags."""

    def __init__(self) -> None:
        self._specs: dict[str, TableSpec] = {}

    def add(self, spec: TableSpec) -> TableSpec:
        self._specs[spec.name] = spec
        return spec

    def spec(self, name: str | int) -> TableSpec:
        return self._specs[CATALOGUE[name] if isinstance(name, int) else name]

    def load(self, spark: SparkSession, name: str | int, path: str | None = None, which: str | None = None):
        """``(df, target, categorical)``: pruned columns and a name->bool map."""
        spec = self.spec(name)
        if path:
            spec = replace(spec, path=path)
        df = read_parquet(spark, spec.path)
        target = spec.target(which)
        df = df.select(*dict.fromkeys((*spec.key, *spec.features, target)))
        return df, target, categorical_flags(df, spec.features)


def categorical_flags(df: DataFrame, features: Sequence[str]) -> dict[str, bool]:
    """True for every string feature, from the schema alone."""
    return {f: isinstance(df.schema[f].dataType, StringType) for f in features}


def read_delimited(
    spark: SparkSession, path: str, schema: StructType, sep: str = ";", index_column: bool = True
) -> DataFrame:
    """Delimited text with a header; the first column is an index and is dropped.

    A schema is required: inference would read the files twice.
    """
    df = (
        spark.read.schema(schema)
        .option("sep", sep)
        .option("header", True)
        .option("mode", "FAILFAST")
        .csv(path)
    )
    return df.drop(df.columns[0]) if index_column else df


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def columns_at(df: DataFrame, start: int, stop: int) -> DataFrame:
    """Columns by position, half open."""
    return df.select(df.columns[start:stop])


def choose_target(df: DataFrame, spec: TableSpec, which: str, out: str = "y") -> DataFrame:
    """Rename one of several targets to ``out``, drop the others, name the data set."""
    target = spec.target(which)
    others = [c for c in spec.targets.values() if c != target]
    return df.withColumnRenamed(target, out).drop(*others).withColumn(
        "dataset_name", F.lit(spec.dataset_name(which))
    )


def number_copies(df: DataFrame, columns: Sequence[str] | None = None, out: str = "copy_no",
                  chunk: int = 100_000) -> DataFrame:
    """Give every copy of a repeated row its own number, 1..m.

    For tables without a key: (all columns, copy number) is one. Copies are
    counted with a map-side combine, so a row repeated a billion times crosses
    the shuffle as a count; it is then unfolded in chunks spread over tasks.
    """
    columns = list(columns or df.columns)
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_m"))
    starts: Column = F.sequence(F.lit(0).cast("long"), F.col("_m") - 1, F.lit(chunk).cast("long"))
    unfolded = counted.select(*columns, "_m", F.explode(starts).alias("_start"))
    # Only the chunks of heavily repeated rows are worth spreading out.
    heavy = unfolded.filter(F.col("_m") > chunk).repartition(*columns, "_start")
    light = unfolded.filter(F.col("_m") <= chunk)
    return light.unionByName(heavy).select(
        *columns,
        F.explode(
            F.sequence(F.col("_start") + 1, F.least(F.col("_start") + chunk, F.col("_m")))
        ).alias(out),
    )
