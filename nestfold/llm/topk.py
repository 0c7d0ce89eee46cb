"""Exact top-k inner products by a three-phase uniform threshold.

A score is the sum of the partial scores of a few slices of the dimensions, so
each slice is a score list of its own, as in the uniform-threshold algorithm:

1. Every slice list gives its k best entries per block of rows; these few are
   scored in full, and the k-th best full score of a query is a safe cutoff:
   the k-th best of all cannot be lower.
2. The cutoff goes back to all lists. A row whose total reaches the cutoff has
   at least one partial score of cutoff / slices or more, so the entries above
   that uniform threshold are sufficient.
3. The entries gathered so are resolved exactly, and the k best remain.

Equal vectors are one class with its smallest distinct ids only (as many as can be
asked for) and how many rows have each, so a vector that a third of all rows share
is scored once, and rows that repeat an id take no place of another id. Classes
and queries meet in blocks: a block of queries is sent to each block of rows.
The work is one multiplication per (query, row) and slice, which an exact
search over all rows cannot avoid; between tasks go only blocks and k entries
per (query, block).
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from nestfold.llm.base import query, table
from nestfold.session import ship_package
from nestfold.sources.storage import materialize

SLICES = 4
ROW_BLOCK = 4096
QUERY_BLOCK = 512
LARGEST = 1 << 53  # of a scaled component


def usable(vector: str) -> Column:
    """Not null, and no null or non-finite component."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True))


def classes(df: DataFrame, vec_id: str, vector: str, is_query: Column, keep: int) -> DataFrame:
    """One row per distinct vector: ``v``, its ``keep`` smallest distinct ids with their rows, and whether a query has it.

    Equal rows are counted and ranks are limited before the shuffle too, so a hot vector is not gathered.
    """
    rows = df.filter(usable(vector) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"), is_query.alias("q"))
    rows = rows.withColumn("h", F.xxhash64("v"))
    by_vector = Window.partitionBy("h", "v").orderBy("id")
    ids = (
        rows.groupBy("h", "v", "id").agg(F.least(F.count(F.lit(1)), F.lit(keep)).alias("n"))
        .withColumn("r", F.row_number().over(by_vector)).filter(F.col("r") <= keep)
        .groupBy("h", "v").agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("ids"))
    )
    asked = rows.groupBy("h", "v").agg(F.max("q").alias("q"))
    return ids.join(asked, ["h", "v"]).select(F.col("ids")[0]["id"].alias("cid"), "h", "v", "ids", "q")


def own_vectors(df: DataFrame, vec_id: str, vector: str, is_query: Column) -> int:
    """The most different vectors that the id of a query has."""
    rows = df.filter(usable(vector) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("id"), F.xxhash64(vector).alias("h"), is_query.alias("q"))
    per_id = rows.groupBy("id", "h").agg(F.max("q").alias("q")).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("q").alias("q"))
    return per_id.filter("q").agg(F.max("n")).first()[0] or 1


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of equal width; shorter vectors are filled up with zeros."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width))
    out[np.repeat(np.arange(len(lists)), sizes), np.concatenate([np.arange(n) for n in sizes] or [[]]).astype(int)] = flat
    return out


class _Block:
    """Partial scores of one block of queries against one block of rows."""

    def __init__(self, row: dict, slices: int):
        qv, cv = row["qv"].values, row["cv"].values
        width = max([0] + [len(x) for x in (*qv, *cv)])
        q, c = _matrix(qv, width), _matrix(cv, width)
        bound = (np.abs(q).max(initial=0) * np.abs(c).max(initial=0)) * max(width, 1)
        kind = np.float64 if bound < 2**53 else np.int64  # doubles hold such sums exactly, and multiply faster
        if bound >= 2**62 and (np.abs(q) @ np.abs(c).T).max() >= 2**62:
            raise ValueError("scores do not fit a long")
        q, c = q.astype(kind), c.astype(kind)
        self.cids = row["cids"].values.to_numpy(zero_copy_only=False)
        self.keys = row["keys"].values.to_numpy(zero_copy_only=False)
        self.qids = row["qids"].values.to_numpy(zero_copy_only=False)
        cuts = np.linspace(0, width, slices + 1).astype(int)
        self.parts = [q[:, a:b] @ c[:, a:b].T for a, b in zip(cuts, cuts[1:])]

    def best(self, scores: np.ndarray, columns: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of one query: by score, then by smaller id."""
        order = np.lexsort((self.cids[columns], -scores))[:k]
        return columns[order], scores[order]


def _rows(batches: Iterator[pa.RecordBatch], slices: int) -> Iterator[tuple[pa.RecordBatch, int, _Block]]:
    for batch in batches:
        names = batch.schema.names
        for i in range(batch.num_rows):
            yield batch, i, _Block({n: batch.column(names.index(n))[i] for n in ("qv", "cv", "qids", "cids", "keys")}, slices)


_FOUND = "qid long, cid long, key long, score long"


def _emit(qid: list, cid: list, key: list, score: list) -> pa.RecordBatch:
    join = lambda x: np.concatenate(x) if x else np.zeros(0)
    return pa.record_batch(
        [pa.array(join(x).astype(np.int64)) for x in (qid, cid, key, score)], ["qid", "cid", "key", "score"])


def local_lists(k: int, slices: int):
    """Phase 1: k entries of each slice list per query and block, scored in full, the k best of them."""
    def run(batches):
        for _, _, block in _rows(batches, slices):
            total = sum(block.parts)
            qid, cid, key, score = [], [], [], []
            n = total.shape[1]
            tops = [np.argpartition(p, n - k, axis=1)[:, n - k:] if n > k else
                    np.tile(np.arange(n), (len(p), 1)) for p in block.parts]
            near = np.concatenate(tops, axis=1)
            for i, row in enumerate(near):
                columns, scores = block.best(total[i, row := np.unique(row)], row, k)
                qid.append(np.full(len(columns), block.qids[i]))
                cid.append(block.cids[columns])
                key.append(block.keys[columns])
                score.append(scores)
            yield _emit(qid, cid, key, score)
    return run


def above_threshold(k: int, slices: int):
    """Phases 2 and 3: entries above the uniform threshold of any list, resolved exactly."""
    def run(batches):
        for batch, i, block in _rows(batches, slices):
            cutoff = batch.column(batch.schema.names.index("cutoffs"))[i].values.to_numpy(zero_copy_only=False).astype(float)
            threshold = (cutoff / slices)[:, None]
            enough = np.zeros(block.parts[0].shape, bool)
            for part in block.parts:
                enough |= part >= threshold
            at_q, at_c = np.nonzero(enough)
            exact = sum(part[at_q, at_c] for part in block.parts)
            stay = exact >= cutoff[at_q]
            at_q, at_c, exact = at_q[stay], at_c[stay], exact[stay]
            order = np.lexsort((block.cids[at_c], -exact, at_q))
            at_q, at_c, exact = at_q[order], at_c[order], exact[order]
            first = np.searchsorted(at_q, at_q)  # where the query's entries begin
            top = np.arange(len(at_q)) - first < k
            yield _emit([block.qids[at_q[top]]], [block.cids[at_c[top]]], [block.keys[at_c[top]]], [exact[top]])
    return run


def _blocks(df: DataFrame, size: int, prefix: str, *columns: str) -> DataFrame:
    """Rows of ``df`` packed into arrays, about ``size`` rows in each."""
    n = max(1, -(-df.count() // size))
    packed = df.withColumn("block", F.pmod(F.xxhash64("cid", F.lit(7)), F.lit(n))).groupBy("block")
    one = F.sort_array(F.collect_list(F.struct("cid", "x", *columns)))
    out = packed.agg(one.alias("rows")).select(
        F.col("block").alias(f"{prefix}block"), F.col("rows.cid").alias(f"{prefix}ids"),
        F.col("rows.x").alias(f"{prefix}v"), *[F.col(f"rows.{c}").alias(f"{c}s") for c in columns])
    return out


def search(
    df: DataFrame, k: int, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding",
    scale: int = 256, slices: int = SLICES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each query row, ties to smaller ids.

    Components count as floor(scale * x). Vectors that are null or hold a null
    or non-finite component, and rows without an id, take no part; shorter
    vectors count as filled up with zeros; repeated rows are rows of their own
    with one id, of which a query never meets its own, however many rows and
    vectors have it; a repeated query row has one list. Scores must fit a
    long: where they do not, or a finite component times ``scale`` reaches 2^53, it is an error.
    """
    spark = df.sparkSession
    ship_package(spark)
    ints = df.withColumn(vector, F.transform(F.col(vector), lambda x: F.when(
        x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))),
        F.when(F.abs(x.cast("double") * scale) < F.lit(float(LARGEST)), F.floor(x.cast("double") * scale))
        .otherwise(F.raise_error(F.lit("a finite component is too large for exact scores")).cast("bigint")))))
    keep = k + own_vectors(ints, vec_id, vector, is_query)  # as many as a query's own id can take
    found = materialize(classes(ints, vec_id, vector, is_query, keep), "topk-classes")
    if found.groupBy("h").count().filter("count > 1").limit(1).count():
        raise ValueError("two vectors share a hash")
    asked = found.filter("q")
    rows = _blocks(found.select("cid", F.col("v").alias("x"), F.col("h").alias("key")), ROW_BLOCK, "c", "key")
    ask = asked.select(F.col("h").alias("cid"), F.col("v").alias("x"))
    n_blocks = max(1, -(-ask.count() // QUERY_BLOCK))
    sent = rows.withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<bigint>")))

    def pairs(queries: DataFrame) -> DataFrame:
        return sent.join(queries, "qblock").repartition(F.col("qblock"), F.col("cblock"))

    first = pairs(_blocks(ask, QUERY_BLOCK, "q")).mapInArrow(local_lists(keep, slices), _FOUND)
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "cid", "key")
    cutoffs = (
        first.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= keep)
        .groupBy("qid").agg(
            F.when(F.count(F.lit(1)) >= keep, F.min("score")).otherwise(F.lit(-(1 << 62))).alias("cutoff"))
    )
    with_cutoff = ask.join(cutoffs, ask["cid"] == cutoffs["qid"]).select("cid", "x", "cutoff")
    second = pairs(_blocks(with_cutoff, QUERY_BLOCK, "q", "cutoff")).mapInArrow(above_threshold(keep, slices), _FOUND)
    # A class stands for its smallest ids; ``keep`` distinct ones are enough when the query's own is among them.
    classed = (
        second.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= keep)
        .join(found.select(F.col("h").alias("key"), "ids"), "key")
        .select("qid", "score", F.explode("ids").alias("one")).select("qid", "score", F.col("one.id").alias("vec_id"), "one.n")
    )
    members = ints.filter(usable(vector) & F.col(vec_id).isNotNull() & is_query).select(
        F.col(vec_id).cast("long").alias("query_id"), F.xxhash64(vector).alias("h"), F.col(vector).alias("v")).distinct()
    owners = members.join(asked.select("h", "v", F.col("h").alias("qid")), ["h", "v"]).select("query_id", "qid")
    by_class = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    lists = (
        classed.withColumn("r", F.row_number().over(by_class)).filter(F.col("r") <= keep)
        .groupBy("qid").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "n"))).alias("top"))
    )
    return (
        owners.join(lists, "qid")
        .withColumn("top", F.filter("top", lambda x: x["vec_id"] != F.col("query_id")))
        .withColumn("top", F.slice(F.flatten(F.transform("top", lambda x: F.array_repeat(x, x["n"].cast("int")))), 1, k))
        .select("query_id", F.posexplode("top").alias("at", "x"))
        .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"),
                (-F.col("x.s")).alias("score"))
    )


@query("op5_exact_topk", """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT vec_id, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS c FROM e),
s AS (SELECT q.vec_id AS query_id, r.vec_id, sum(q.c * r.c)::BIGINT AS score
    FROM x q JOIN x r ON q.i = r.i AND q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 5
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows for every row whose id is divisible by 50."""
    return search(table(spark, sf_dir, "embeddings"), 5, F.col("vec_id") % 50 == 0)
