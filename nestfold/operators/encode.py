"""Feature encodings, each computed within the row."""

from __future__ import annotations

from itertools import chain
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType


def year_offset(column: str, base: int = 1985) -> Column:
    """Years since ``base``, from the first four characters of date text."""
    return F.substring(F.col(column).cast("string"), 1, 4).cast("int") - F.lit(base)


def binary_flag(column: str, level: str) -> Column:
    return F.when(F.col(column) == level, 1).otherwise(0)


def ordinal(column: str, levels: Sequence[str]) -> Column:
    """Position in ``levels``; any other value stops the job."""
    table = F.create_map(*chain.from_iterable((F.lit(v), F.lit(i)) for i, v in enumerate(levels)))
    unknown = F.raise_error(
        F.concat(F.lit(f"{column}: unknown level "), F.coalesce(F.col(column), F.lit("null")))
    ).cast("int")
    return F.coalesce(table[F.col(column)], unknown)


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def one_hot_levels(df: DataFrame, columns: Sequence[str] | None = None, max_levels: int = 10_000) -> dict[str, list[str]]:
    """Sorted levels of every string column, found in one pass.

    Levels become columns, so their number must be small in any case; a column
    that breaks this (an identifier, say) is reported instead of collected.
    """
    columns = list(columns if columns is not None else string_columns(df))
    if not columns:
        return {}
    pairs = df.select(
        F.explode(F.array(*[
            F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("level")) for c in columns
        ])).alias("p")
    ).select("p.name", "p.level").distinct()
    rows = pairs.limit(max_levels + 1).collect()
    if len(rows) > max_levels:
        raise ValueError(f"more than {max_levels} levels in {columns}; one-hot coding needs fewer")
    found: dict[str, list[str]] = {c: [] for c in columns}
    for row in rows:
        if row.level is None:
            raise ValueError(f"{row.name} has nulls")
        found[row.name].append(row.level)
    return {c: sorted(v) for c, v in found.items()}


def kept_levels(levels: Sequence[str]) -> list[str]:
    """All levels, but only the second one of a two-level column."""
    return list(levels[1:]) if len(levels) == 2 else list(levels)


def one_hot(df: DataFrame, levels: Mapping[str, Sequence[str]]) -> DataFrame:
    """Replace each column by 0/1 columns named ``column=level``."""
    coded = [
        F.when(F.col(c) == v, 1.0).otherwise(0.0).alias(f"{c}={v}")
        for c, all_levels in levels.items() for v in kept_levels(all_levels)
    ]
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in levels], *coded)


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features", keep: Sequence[str] = ()) -> DataFrame:
    """Features as one array of 32-bit floats."""
    dense = F.array(*[F.col(f"`{c}`").cast("float") for c in columns])
    return df.select(*keep, dense.alias(out))
