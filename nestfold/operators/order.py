"""Exact positions in a global or per-group order, without a one-task window.

Three tools:

* ``find_cuts``: the hash values at given ranks. Folds, samples and hold-outs
  then are comparisons with literals: no shuffle of the data at all.
* ``with_rank``: the rank itself for every row, for batches.
* ``running``: running sums, minima and maxima per group, where a group may be
  far larger than one task should take.
"""

from __future__ import annotations

from typing import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

MAX_PREFIX = 5  # hex digits: at most 16^5 buckets, the bound on what is broadcast or summed in one task


def prefix_length(df: DataFrame) -> int:
    """Hex digits so that there are 16 or more buckets per shuffle partition."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    length = 3
    while length < MAX_PREFIX and 16 ** length < 16 * partitions:
        length += 1
    return length


def find_cuts(
    df: DataFrame,
    hash_col: Column,
    ranks: Callable[[Column], Column],
    scopes: Column | None = None,
) -> dict[int, list[str]]:
    """Hash values at the ranks ``ranks(n)`` of each scope's own order.

    ``ranks`` maps the row count of a scope to an array of 1-based ranks.
    ``scopes`` is an array column with the ids of the scopes a row belongs to
    (default: all rows in scope 0); it may have few distinct values only, as
    rows are first counted per (prefix, scopes). A rank of 0 gives the empty
    string, which is below every hash.

    Two passes over the key column alone: counts per hash prefix, then a look
    into just those prefixes that hold a wanted rank (about n / 16^prefix rows
    each). Returns one string per rank, as plain values.
    """
    length = prefix_length(df)
    scopes = F.array(F.lit(0)) if scopes is None else scopes
    base = df.select(hash_col.alias("h"), scopes.alias("scopes"))
    counts = (
        base.groupBy(F.substring("h", 1, length).alias("prefix"), "scopes")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("prefix", F.explode("scopes").alias("scope"), "n")
    )
    # Rows of one (scope, prefix) are peers in the running sum: all get its end.
    by_scope = Window.partitionBy("scope")
    wanted = (
        counts.withColumn("total", F.sum("n").over(by_scope))
        .withColumn("hi", F.sum("n").over(by_scope.orderBy("prefix")))
        .withColumn("lo", F.col("hi") - F.sum("n").over(Window.partitionBy("scope", "prefix")))
        .select("scope", "prefix", "lo", "hi", F.posexplode(ranks(F.col("total"))).alias("i", "rank"))
        .filter((F.col("rank") > F.col("lo")) & (F.col("rank") <= F.col("hi"))
                | ((F.col("rank") <= 0) & (F.col("lo") == 0)))
        .select("scope", "i", "prefix", "rank", (F.col("rank") - F.col("lo")).alias("within"))
        .collect()
    )
    found = {(r.scope, r.i): "" for r in wanted}
    inside = [r for r in wanted if r["rank"] > 0]
    if inside:
        prefixes = sorted({r.prefix for r in inside})
        near = (
            base.filter(F.substring("h", 1, length).isin(prefixes))
            .select("h", F.substring("h", 1, length).alias("prefix"), F.explode("scopes").alias("scope"))
        )
        bucket = Window.partitionBy("scope", "prefix").orderBy("h")
        hit = F.lit(False)
        for r in inside:
            hit = hit | ((F.col("scope") == r.scope) & (F.col("prefix") == r.prefix) & (F.col("within") == r.within))
        rows = (
            near.withColumn("within", F.row_number().over(bucket))
            .withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("scope", "prefix", "h")))
            .filter(hit).collect()
        )
        if any(r.same > 1 for r in rows):
            raise ValueError("the row key is not unique; number copies first")
        at = {(r.scope, r.prefix, r.within): r.h for r in rows}
        for r in inside:
            found[(r.scope, r.i)] = at[(r.scope, r.prefix, r.within)]
    cuts: dict[int, list[str]] = {}
    for scope, i in sorted(found):
        cuts.setdefault(scope, []).append(found[(scope, i)])
    return cuts


def above(hash_col: Column, cuts: Sequence[str]) -> Column:
    """How many of the cuts lie below the hash: 0 .. len(cuts)."""
    total = F.lit(0)
    for cut in cuts:
        total = total + F.when(hash_col > F.lit(cut), 1).otherwise(0)
    return total


def with_rank(df: DataFrame, hash_col: Column, out: str = "rank") -> DataFrame:
    """1-based exact rank in hash order.

    Rows are counted per hash prefix; the offsets (at most 16^5 rows) are
    broadcast, and row numbers are taken inside each prefix. Hashes of distinct
    keys spread evenly, so no prefix is hot.
    """
    length = prefix_length(df)
    hashed = df.withColumn("_h", hash_col).withColumn("_prefix", F.substring("_h", 1, length))
    counts = hashed.groupBy("_prefix").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_prefix", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_prefix").orderBy("_h")
    return (
        hashed.withColumn("_within", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_prefix")
        .withColumn(out, F.col("_offset") + F.col("_within"))
        .drop("_prefix", "_offset", "_within", "_h")
    )


def value_band(value: Column, per_unit: int = 64) -> Column:
    """A coarse number that grows with ``value``: bands that are narrow near
    zero and widen with size, so that any double falls into a limited number."""
    return F.floor(F.signum(value) * F.log1p(F.abs(value)) * per_unit)


def running(
    df: DataFrame,
    group: Sequence[str],
    bucket: Column,
    order: Sequence[Column | str],
    sums: Mapping[str, Column] | None = None,
    minima: Mapping[str, Column] | None = None,
    maxima: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Running aggregates over all EARLIER rows of the group (own row excluded).

    ``bucket`` must not decrease along ``order``. Each (group, bucket) is one
    window; buckets are summarised, summaries are accumulated per group, and
    added to the rows of the next buckets. So a hot group is spread over as
    many tasks as it has buckets. Sums start at 0, minima and maxima at null.
    """
    sums, minima, maxima = dict(sums or {}), dict(minima or {}), dict(maxima or {})
    specs = (
        [(n, c, F.sum) for n, c in sums.items()]
        + [(n, c, F.min) for n, c in minima.items()]
        + [(n, c, F.max) for n, c in maxima.items()]
    )
    group = list(group)
    base = df.withColumn("_bucket", bucket)
    earlier = (
        Window.partitionBy(*group, "_bucket").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = base.select("*", *[fn(c).over(earlier).alias(f"_in_{n}") for n, c, fn in specs])
    summary = base.groupBy(*group, "_bucket").agg(*[fn(c).alias(f"_all_{n}") for n, c, fn in specs])
    previous = (
        Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = summary.select(
        *group, "_bucket", *[fn(f"_all_{n}").over(previous).alias(f"_pre_{n}") for n, _, fn in specs]
    )
    joined = local.join(offsets, [*group, "_bucket"])
    combined = []
    for name, _, fn in specs:
        inside, before = F.col(f"_in_{name}"), F.col(f"_pre_{name}")
        if fn is F.sum:
            value = F.coalesce(inside, F.lit(0)) + F.coalesce(before, F.lit(0))
        elif fn is F.min:
            value = F.least(inside, before)
        else:
            value = F.greatest(inside, before)
        combined.append(value.alias(name))
    return joined.select(*df.columns, *combined)


def with_position(
    df: DataFrame, group: Sequence[str], order: Sequence[str], bucket: Column, out: str = "pos"
) -> DataFrame:
    """0-based position of each row within its group."""
    return running(df, group, bucket, order, sums={out: F.lit(1).cast("long")})


def time_bucket(stamp: str, unit: str = "hour") -> Column:
    """A bucket along time for ``running``."""
    return F.date_trunc(unit, F.col(stamp))
