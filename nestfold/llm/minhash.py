"""Near-duplicate documents by SuperMinHash signatures, banding, exact verification and components.

Signatures: every element of a set draws one random number per rank and walks
through a random permutation of the signature's places; the value at a place is
rank + draw, and a place keeps the smallest. As ranks come in order, a set
stops as soon as all its places are below the next rank: a text with many more
elements than places needs two or three ranks. Values at different places are
negatively correlated, which lowers the variance of plain min-wise hashing.

Candidates: 128 places in 32 bands of 4 meet a pair of similarity 0.8 with
probability 1 - 5e-8. Texts with equal sets are one class, so exact copies
cost one row. Within a bucket nothing is paired with everything:

1. every member meets the bucket's hub, which is drawn anew for each bucket;
2. verified links are joined to components, and all hub pairs that were tested
   to families;
3. a family that is not yet one component is tested in blocks of a bounded
   number of shingles: a task takes two blocks, counts all intersections as a
   matrix product, and returns a spanning forest of the links it finds;
4. pairs of different families that share a bucket are tested one by one.

So no pair of a shared bucket stays untested unless it is in one component
already, the sizes exclude the similarity, or a 128-bit sketch of the
signatures does (at most 34 bits differ at 0.8 but for about one pair in 10^8).

Defined results: null and empty texts have an empty set and link to nothing; a
text with fewer words than a shingle is one shingle; a null id counts as the
smallest id; rows that share an id count as one document.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from nestfold.llm import text as T
from nestfold.llm.base import key, query, table, unkey
from nestfold.llm.components import connected
from nestfold.session import ship_package
from nestfold.sources.storage import materialize

PLACES, BANDS = 128, 32
SKETCH_BITS = 34  # most differing bits of two sketches
BLOCK_ITEMS, BLOCK_DOCS = 100_000, 512  # shingles and documents of a block, on average at most
_SLICE = 8192  # shingles multiplied at once
#: Ids that may be broadcast to fetch texts (16 MB); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
_U = np.uint64
_LEVEL = _U(56)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct hashes of the word shingles of each text, A-Z taken as a-z."""
    starts, ends, words = T.word_spans(data, offsets)
    h = T.span_hashes(data, starts, ends, lower=True)
    rolled = h
    for step in range(1, size):
        rolled = T.pair_hashes(rolled[:-1], h[step:]) if len(rolled) else rolled
    out = []
    for a, b in zip(words[:-1], words[1:]):
        if b - a >= size:
            out.append(np.unique(rolled[a:b - size + 1]))
        elif b > a:
            short = h[a]
            for x in h[a + 1:b]:
                short = T.pair_hashes(np.array([short]), np.array([x]))[0]
            out.append(T.mix(np.array([short + _U(b - a)])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def super_minhash(elements: np.ndarray, places: int = PLACES) -> np.ndarray:
    """The signature of one set: per place, rank in the top byte and the draw below it."""
    n = len(elements)
    signature = np.full(places, ~_U(0))
    order = np.tile(np.arange(places, dtype=np.uint8), (n, 1))
    row = np.arange(n)
    for rank in range(places):
        draw = T.mix(elements + _U((2 * rank + 1) * 0x9E3779B97F4A7C15 % 2**64))
        pick = T.mix(draw ^ _U(0x6A09E667F3BCC909))
        other = rank + (pick % _U(places - rank)).astype(np.int64)
        place = order[row, other]
        order[row, other] = order[:, rank]
        order[:, rank] = place
        np.minimum.at(signature, place, (_U(rank) << _LEVEL) | (draw >> _U(8)))
        if int(signature.max()) >> 56 <= rank:
            break
    return signature


def _bands(signature: np.ndarray, bands: int) -> np.ndarray:
    parts = signature.reshape(bands, -1)
    keys = T.mix(np.arange(bands, dtype=np.uint64) + _U(1))
    for column in parts.T:
        keys = T.pair_hashes(keys, column)
    return keys.view(np.int64)


def _sketch(signature: np.ndarray) -> np.ndarray:
    bits = (T.mix(signature) & _U(1)).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


_SKETCH = "id long, n long, digest binary, bands array<long>, b1 long, b2 long"


def _sketches(size: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for row, data, offsets in T.chunks(T.column(batch, "text")):
                sets = shingle_sets(data, offsets, size)
                n, digests, bands, b1, b2 = [], [], [], [], []
                for s in sets:
                    n.append(len(s))
                    if not len(s):
                        digests.append(None)
                        bands.append([])
                        b1.append(0)
                        b2.append(0)
                        continue
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    signature = super_minhash(s)
                    bands.append(_bands(signature, BANDS))
                    x, y = _sketch(signature)
                    b1.append(int(x))
                    b2.append(int(y))
                yield pa.record_batch(
                    [ids.slice(row, len(sets)), pa.array(n, pa.int64()), pa.array(digests, pa.binary()),
                     pa.array(bands, pa.list_(pa.int64())), pa.array(b1, pa.int64()), pa.array(b2, pa.int64())],
                    ["id", "n", "digest", "bands", "b1", "b2"])
    return run


def _sets(size: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for row, data, offsets in T.chunks(T.column(batch, "text")):
                sets = shingle_sets(data, offsets, size)
                items = [s.view(np.int64) for s in sets]
                yield pa.record_batch([ids.slice(row, len(sets)), pa.array(items, pa.list_(pa.int64()))], ["id", "items"])
    return run


def _similar(percent: int):
    """Keeps the pairs with 100 * intersection >= percent * union."""
    def run(batches):
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3)):
                a, b = left.values.to_numpy(), right.values.to_numpy()
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.record_batch([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))
    return run


def _possible(percent: int) -> Column:
    """Neither sizes nor sketches of ``a`` and ``b`` exclude the similarity."""
    a, b = F.col("a.n"), F.col("b.n")
    differ = F.bit_count(F.col("a.b1").bitwiseXOR(F.col("b.b1"))) + F.bit_count(F.col("a.b2").bitwiseXOR(F.col("b.b2")))
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & (differ <= SKETCH_BITS)


def whole_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, items) of the documents with the distinct ``ids``.

    Texts are fetched by id: broadcast if the ids are few by count, else joined
    by a shuffle; sets are made only for them.
    """
    ids = materialize(ids, "ids")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return materialize(
        docs.join(wanted, "id", "left_semi").mapInArrow(_sets(size), "id long, items array<long>"), "sets")


def verify(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (u, v) that are similar, tested on the whole sets of both texts."""
    sets = whole_sets(docs, pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), size)
    left = sets.select(F.col("id").alias("u"), F.col("items").alias("a"))
    right = sets.select(F.col("id").alias("v"), F.col("items").alias("b"))
    return (
        pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b")
        .mapInArrow(_similar(percent), "u long, v long").distinct()
    )


def _block_links(percent: int):
    """A spanning forest of the links between components, as far as documents of two blocks show them."""
    def sides(members: pa.StructArray):
        lists = members.field("items")
        return members.field("root").to_numpy(), lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())

    def run(batches):
        for batch in batches:
            u, v = [], []
            for left, right in zip(batch.column(0), batch.column(1)):
                (roots, items, n), (roots2, items2, n2) = sides(left.values), sides(right.values)
                shared = np.intersect1d(items, items2)
                both = np.zeros((len(roots), len(roots2)), np.float32)
                for start in range(0, len(shared), _SLICE):
                    part = shared[start:start + _SLICE]
                    tables = []
                    for values, sizes in ((items, n), (items2, n2)):
                        at = np.minimum(np.searchsorted(part, values), len(part) - 1)
                        hit = part[at] == values
                        table_ = np.zeros((len(sizes), len(part)), np.float32)
                        table_[np.repeat(np.arange(len(sizes)), sizes)[hit], at[hit]] = 1
                        tables.append(table_)
                    both += tables[0] @ tables[1].T
                alike = (100 * both >= percent * (n[:, None] + n2[None, :] - both)) & (roots[:, None] != roots2[None, :])
                parent: dict = {}

                def find(x):
                    while parent.get(x, x) != x:
                        x = parent[x]
                    return x

                for i, j in zip(*np.nonzero(alike)):
                    a, b = find(roots[i]), find(roots2[j])
                    if a != b:
                        parent[max(a, b)] = min(a, b)
                        u.append(roots[i])
                        v.append(roots2[j])
            yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
    return run


def within_families(docs: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (u, v) between roots that join the components of each family; ``members`` has ``id``, ``family`` and ``root``."""
    sets = whole_sets(docs, members.select("id").distinct(), size).withColumn("n", F.array_size("items"))
    full = members.join(sets, "id")
    total = full.groupBy("family").agg(
        F.ceil(F.greatest(F.sum("n") / BLOCK_ITEMS, F.count(F.lit(1)) / BLOCK_DOCS)).cast("int").alias("blocks"))
    dealt = full.join(total, "family").withColumn("block", F.pmod(F.xxhash64("id", F.lit(11)), "blocks").cast("int"))
    blocks = materialize(
        dealt.groupBy("family", "blocks", "block").agg(F.collect_list(F.struct("root", "items")).alias("docs")), "blocks")
    left = blocks.select("family", F.col("docs").alias("a"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("block"))
    right = blocks.select("family", "block", F.col("docs").alias("b"))
    met = left.join(right, ["family", "block"]).select("a", "b")
    return met.mapInArrow(_block_links(percent), "u long, v long").distinct()


def near_duplicates(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80
) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of ``df``."""
    ship_package(df.sparkSession)
    docs = df.select(key(doc_id).alias("id"), F.col(text).alias("text"))
    sketched = materialize(docs.mapInArrow(_sketches(size), _SKETCH), "sketches")
    groups = materialize(
        sketched.filter("n > 0").groupBy("digest").agg(
            F.min("id").alias("rep"), F.first("n").alias("n"), F.first("b1").alias("b1"),
            F.first("b2").alias("b2"), F.first("bands").alias("bands")), "classes")
    places = groups.select(F.explode("bands").alias("bucket"), "rep", "n", "b1", "b2")
    shared = places.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("bucket")
    members = materialize(
        places.join(shared, "bucket").withColumn("order", F.xxhash64("bucket", "rep")), "members")
    hubs = members.groupBy("bucket").agg(F.min(F.struct("order", "rep", "n", "b1", "b2")).alias("h")).select("bucket", "h.*")
    in_bucket = F.col("a.bucket") == F.col("b.bucket")
    ends = F.least("a.rep", "b.rep").alias("u"), F.greatest("a.rep", "b.rep").alias("v")
    met = members.alias("a").join(
        hubs.alias("b"), in_bucket & (F.col("a.rep") != F.col("b.rep")) & _possible(percent))
    pairs = materialize(met.select(*ends).distinct(), "pairs")
    links = materialize(verify(docs, pairs, size, percent), "links")
    stars = connected(materialize(
        links.withColumn("tested", F.lit(False)).unionByName(pairs.withColumn("tested", F.lit(True))), "graphs"), ["tested"])
    roots, families = (stars.filter(F.col("tested") == flag).drop("tested") for flag in (False, True))

    def labelled(df: DataFrame, node: str) -> DataFrame:
        return (
            df.join(families.select(F.col("node").alias(node), F.col("root").alias("family")), node, "left")
            .join(roots.select(F.col("node").alias(node), "root"), node, "left")
            .withColumn("family", F.coalesce("family", node)).withColumn("root", F.coalesce("root", node)))

    def mixed(df: DataFrame, group: str) -> DataFrame:
        open_ = df.groupBy(group).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
        return materialize(df.join(open_.select(group), group, "left_semi"), "mixed")

    kin = mixed(labelled(families.select(F.explode(F.array("node", "root")).alias("id")).distinct(), "id"), "family")
    strangers = mixed(labelled(members, "rep"), "bucket")
    across = strangers.alias("a").join(
        strangers.alias("b"), in_bucket & (F.col("a.family") != F.col("b.family")) & (F.col("a.rep") < F.col("b.rep"))
        & (F.col("a.root") != F.col("b.root")) & _possible(percent))
    across = materialize(
        across.select(*ends, F.col("a.root").alias("ru"), F.col("b.root").alias("rv")).distinct(), "pairs")
    merges = []
    if not kin.isEmpty():
        merges.append(within_families(docs, kin, size, percent))
    if not across.isEmpty():
        others = verify(docs, across.select("u", "v"), size, percent)
        merges.append(across.join(others, ["u", "v"]).select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct())
    merged = None
    if merges:
        merged = connected(materialize(reduce(DataFrame.unionByName, merges), "merges"))

    classed = sketched.select("id", "n", "digest").join(groups.select("digest", "rep"), "digest", "left")
    classed = classed.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
    classed = classed.withColumn("root", F.coalesce("root", "rep"))
    if merged is not None:  # roots of the first components that belong together
        final = merged.select(F.col("node").alias("root"), F.col("root").alias("final"))
        classed = classed.join(final, "root", "left").withColumn("root", F.coalesce("final", "root"))
    return classed.select(
        unkey("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.coalesce("root", "id").alias("component")).withColumn("component_id", unkey("component")).drop("component")


def keep_one(df: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest ``doc_id``.

    Rows that are empty stay, each on its own. Of rows that share the id, all stay.
    """
    groups = near_duplicates(df, size=size, percent=percent)
    gone = groups.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_gone")).distinct()
    return df.join(gone, F.col("doc_id").eqNullSafe(F.col("_gone")), "left_anti").select(*df.columns)


@query("op8_minhash_near_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document, on 2-word shingles."""
    groups = near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)
    return groups.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
