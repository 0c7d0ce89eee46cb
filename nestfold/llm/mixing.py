"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Targets: sources share all words by weight; none gets more than ``max_repeat``
times its size, and the excess is shared by weight again until none is above.

Draws: documents of a source fall into blocks by a hash of their key. A source
draws all its blocks once for each whole epoch of its target, and for the rest
a prefix of freshly permuted blocks; the block at the cut gives the prefix of
its documents that comes nearest. The tree then splits the exact block quotas
of all sources among the output shards: a node with many shards gives its left
half a multivariate-hypergeometric draw of its quotas. A shard takes that many
of the next permuted blocks of each source, so blocks are disjoint, and mixes
its rows by a hash.

Documents are shuffled once, by block. Sums over blocks go by (source, bucket
of the permutation), so a source with a third of all words is many tasks. The
tables of sources and of tree nodes are small: one row per source, and per
(shard, source) at most.

Defined results: a null source is a source of its own and sorts last; a null or
empty text has no words and is never drawn; draws depend on the key and the text, so
equal rows are drawn alike, and reruns agree.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from nestfold.llm.base import WORD, free_name, key, query, table
from nestfold.operators.order import running, with_position
from nestfold.session import ship_package
from nestfold.sources.storage import materialize

BLOCK_WORDS = 50_000
SHARD_WORDS = 2_000_000
#: Sources that may be broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 10_000


def targets(sizes: DataFrame, weights: Sequence[float], max_repeat: float) -> DataFrame:
    """``sizes`` (source, source_size) with ``sid`` (order of the names), ``weight`` and ``target``.

    Sources sorted by limit / weight are at their limit up to some place; the
    level of all others follows from sums before and after that place.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("sid", F.row_number().over(named) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")))
    limit = F.col("source_size") * float(max_repeat)
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", "sid")
    levels = (
        ranked.withColumn("limit", limit).withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("below", F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("above", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("below")) / F.col("above"))
        .withColumn("open", F.when(F.col("level") <= F.col("ratio"), F.col("level")))
    )
    # The levels of places that are too early are too high, so the first open place is the one with the highest level.
    level = F.first("open", ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levels.withColumn("target", F.least(F.col("limit"), F.coalesce(level, F.col("ratio")) * F.col("weight"))).select(
        "source", "sid", "weight", "source_size", "target")


def _split(seed: int):
    def run(node: pd.DataFrame) -> pd.DataFrame:
        """Gives the left half of a node's shards its share of every source's quota."""
        lo, hi = int(node["lo"].iloc[0]), int(node["hi"].iloc[0])
        if hi - lo < 2:
            return node
        node = node.sort_values("sid")
        quota = node["quota"].to_numpy(np.int64)
        mid = (lo + hi) // 2
        share = int(round(int(quota.sum()) * (mid - lo) / (hi - lo)))
        rng = np.random.Generator(np.random.PCG64([seed, lo, hi]))
        left = rng.multivariate_hypergeometric(quota, share, method="marginals")
        halves = [node.assign(lo=a, hi=b, quota=q) for a, b, q in ((lo, mid, left), (mid, hi, quota - left))]
        return pd.concat(halves)[lambda x: x["quota"] > 0]
    return run


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, sid, quota): exact quotas per shard; they add up to ``quotas`` (sid, quota)."""
    nodes = quotas.select(
        F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), F.col("sid").cast("long").alias("sid"),
        F.col("quota").cast("long").alias("quota"))
    for _ in range((shards - 1).bit_length()):
        nodes = nodes.groupBy("lo", "hi").applyInPandas(_split(seed), nodes.schema)
    return nodes.select(F.col("lo").alias("shard"), "sid", "quota")


def _top_byte(column: str):
    return F.shiftright(F.col(column), 56)


def plan(
    df: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeat: float = 3, seed: int = 17,
    block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, doc_id: str = "doc_id", text: str = "text",
    source: str = "source", out: str = "mix",
) -> DataFrame:
    """``df`` with a struct ``out``: size, source_size, target, and draws, the (epoch, shard) of each copy."""
    spark = df.sparkSession
    ship_package(spark)
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    # The caller's columns travel as one, so that no name of theirs meets one of ours.
    sized = df.select(F.struct("*").alias("_row"), size.alias("_size"), F.col(source).alias("_source"),
                      F.xxhash64(key(doc_id), F.col(text), F.lit(seed)).alias("_key"))
    sources = materialize(targets(
        sized.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size")), weights, max_repeat), "sources")
    sources = sources.withColumn("full", F.when(F.col("source_size") > 0, F.floor(
        F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("int")).withColumn(
        "rest", F.greatest(F.lit(0.0), F.col("target") - F.col("full") * F.col("source_size"))).withColumn(
        "blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long"))
    known = sources.select(F.col("source").alias("_name"), *[F.col(c).alias(f"_{c}") for c in ("sid", "source_size", "target", "blocks")])
    known = F.broadcast(known) if sources.count() <= BROADCAST_SOURCES else known
    placed = sized.join(known, F.col("_source").eqNullSafe(F.col("_name")), "left").withColumn(
        "_block", F.pmod(F.col("_key"), F.col("_blocks")))
    blocks = placed.groupBy(F.col("_sid").alias("sid"), F.col("_block").alias("block")).agg(F.sum("_size").alias("words"))
    blocks = materialize(blocks, "blocks")
    drawn = (
        blocks.join(sources.select("sid", "full", "rest"), "sid")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("full"))))
        .withColumn("order", F.xxhash64("sid", "block", "epoch", F.lit(seed)))
    )
    rest = running(drawn.filter("epoch = full"), ["sid"], _top_byte("order"), ["order", "block"], sums={"before": F.col("words")})
    draws = drawn.filter("epoch < full").withColumn("limit", F.lit(None).cast("double")).select(
        "sid", "block", "epoch", "order", "limit").unionByName(
        rest.filter("before < rest").withColumn(
            "limit", F.when(F.col("before") + F.col("words") > F.col("rest"), F.col("rest") - F.col("before")))
        .select("sid", "block", "epoch", "order", "limit"))
    draws = materialize(with_position(
        draws, ["sid"], ["epoch", "order", "block"], F.col("epoch") * 256 + _top_byte("order") + 128, out="draw"), "draws")
    total = sources.agg(F.sum("target")).first()[0] or 0.0
    shards = max(1, -(-int(total) // shard_words))
    leaves = split_quotas(draws.groupBy("sid").agg(F.count(F.lit(1)).alias("quota")), shards, seed)
    before = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    taken = (
        leaves.filter("quota > 0").withColumn("from", F.coalesce(F.sum("quota").over(before), F.lit(0)))
        .select("sid", "shard", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("quota") - 1)).alias("draw"))
    )
    per_block = materialize(
        draws.join(taken, ["sid", "draw"]).groupBy("sid", "block").agg(
            F.array_sort(F.collect_list(F.struct("epoch", "shard", "limit"))).alias("_drawn"))
        .select(F.col("sid").alias("_sid"), F.col("block").alias("_block"), "_drawn"), "per-block")
    inside = Window.partitionBy("_sid", "_block").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    met = placed.join(per_block, ["_sid", "_block"], "left").withColumn(
        "_before", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    chosen = F.filter(F.coalesce("_drawn", F.array().cast("array<struct<epoch:int,shard:bigint,limit:double>>")), lambda d: (
        (F.col("_size") > 0) & (d["limit"].isNull() | (F.col("_before") + F.col("_size") / 2 <= d["limit"]))))
    return met.withColumn("_plan", F.struct(
        F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        F.transform(chosen, lambda d: F.struct(d["epoch"].alias("epoch"), d["shard"].alias("shard"))).alias("draws"),
    )).select("_row.*", F.col("_plan").alias(out))


def mix(df: DataFrame, seed: int = 17, **options) -> DataFrame:
    """One row per copy with ``df``'s columns, dealt to its shard and there in a hashed order."""
    mixed, draw, placed = (free_name(df, n) for n in ("_mix", "_draw", "_order"))
    copies = plan(df, seed=seed, out=mixed, **options).select(*df.columns, F.explode(f"{mixed}.draws").alias(draw))
    order = F.xxhash64(key("doc_id"), draw, F.lit(seed))
    return copies.repartition(f"{draw}.shard").withColumn(placed, order).sortWithinPartitions(f"{draw}.shard", placed).select(*df.columns)


@query("op3_source_mixing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, with its shards."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    m = plan(docs).select("doc_id", "source", "mix.*")
    return m.select("doc_id", "source", "size", "source_size", "target",
                    (F.col("size") * F.size("draws")).cast("long").alias("taken"),
                    F.array_join(F.transform("draws", lambda d: d["shard"].cast("string")), ",").alias("shards"))
