"""Registry of this subpackage's queries, and what its operators share."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null id: the smallest long, so such rows come first.
NULL_ID = -(1 << 63)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores in front, so that ``df`` has no such column."""
    while name in df.columns:
        name = "_" + name
    return name


def key(name: str) -> Column:
    """An id column without nulls."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def unkey(name: str) -> Column:
    """The id as it was: null for what stood for null."""
    return F.when(F.col(name) != F.lit(NULL_ID), F.col(name))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
