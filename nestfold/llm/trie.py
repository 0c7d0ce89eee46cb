"""The prefix trie of conversations as a z-fast trie: compacted nodes in a hash table.

A prefix of turns is named by 128 bits: each turn is hashed together with its place
and the hashes are summed, so all prefixes of a conversation come from one running
sum. A conversation is stored as its path, the names of its prefixes in chunks.

A compacted node covers an edge, the depths from below its parent's to its own. It is kept
under the name of the prefix at its handle, the depth of its edge that most
powers of two divide. To find where a conversation leaves the trie, a binary search
halves the depths at such places only: one lookup per step, by name,
whatever nodes there are. First the steps between chunks are taken, then
those inside one. The edge at which the search ends is compared name by name.

Conversations that are equal as a whole are one path with a count. Paths are
inserted in batches: a small one builds the trie; paths of the next one are located
in it, and only the parts below their exits are grouped into new nodes. Edges left midway are split.
At the end, sums over subtrees are taken by doubling the pointers to ancestors, and
edges are expanded along the paths that run through them.

Defined results: null roles and texts count as empty; turns go by number (null
first), then role and text; equal rows are turns of their own. Rows with a null
conversation id are one conversation, which is the smallest, is rebuilt from itself and is
written ``null``. No rows give no nodes, not even the root. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from typing import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from nestfold.llm.base import NULL_ID, key, query, table, unkey
from nestfold.operators.order import running
from nestfold.session import ship_package
from nestfold.sources.storage import materialize

CHUNK = 256  # prefixes in a row of a path; a power of two
BATCHES = (1 / 16, 1.0)  # share of the paths that is in the trie after each batch
FAMILY, MOST_SHARED = 5, 9  # conversations of a family share fewer turns than that with its first
_IDS = 4096  # conversation ids that are sorted and joined at once
_ROOT = hashlib.md5(b"root").digest()


def _root() -> Column:
    return F.lit(_ROOT)


def _shift(name: str, value: Column, by: Column) -> Column:
    return F.call_function(name, value, by)


def fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] that the largest power of two divides."""
    bits = F.length(F.bin(low.bitwiseXOR(high))) - 1
    return _shift("shiftleft", _shift("shiftright", high, bits), bits)


# -- paths ------------------------------------------------------------------------------

def rebuilt(df: DataFrame) -> DataFrame:
    """(conv, place, name, bytes): the turns of all rebuilt conversations, and (conv, n) rows of all ids.

    A conversation c is the first h turns of c - c % 5, then its own after its first h; h is crc32(c) % 9.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    base = df.select(key("conv_id").alias("conv"), key("turn").alias("turn"), role.alias("r"), text.alias("t"))
    own = running(base, ["conv"], F.floor(F.col("turn") / 64), ["turn", "r", "t"], sums={"at": F.lit(1).cast("long")})
    own = materialize(own.select(
        "conv", "at", F.unhex(F.sha2(F.concat(F.octet_length("r").cast("string"), F.lit(":"), "r", "t").cast("binary"), 256)).alias("turn"),
        F.octet_length("t").cast("long").alias("bytes")), "own-turns")
    none = F.col("conv") == NULL_ID
    convs = own.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).select(
        "conv", "n", F.when(none, NULL_ID).otherwise(F.col("conv") - F.col("conv") % FAMILY).alias("first"),
        F.when(none, 0).otherwise(F.crc32(F.col("conv").cast("string").cast("binary")) % MOST_SHARED).alias("h"))
    firsts = convs.select(F.col("conv").alias("first"), F.col("n").alias("first_n"))
    convs = materialize(convs.join(firsts, "first", "left").withColumn("first_n", F.coalesce("first_n", F.lit(0))), "convs")
    rest = own.join(convs.select("conv", "h", "first_n"), "conv").filter("at >= h").select(
        "conv", (F.col("at") - F.col("h") + F.least("h", "first_n")).alias("place"), "turn", "bytes")
    shared = own.filter(F.col("at") < MOST_SHARED).withColumnRenamed("conv", "first").join(
        convs.select("conv", "first", "h"), "first").filter("at < h").select("conv", F.col("at").alias("place"), "turn", "bytes")
    return materialize(rest.unionByName(shared), "rebuilt"), convs


def paths(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv, chunk, above, steps): names of all prefixes; ``above`` is the name before the first.

    A step has the name, and the bytes of text before it and with it.
    """
    parts, low = [], 0xFFFFFFFF
    for seed in (1, 2):
        hashed = F.xxhash64(F.lit(seed), F.col("place"), F.col("turn"))
        parts += [hashed.bitwiseAND(F.lit(low)), _shift("shiftrightunsigned", hashed, F.lit(32))]
    names = [f"s{i}" for i in range(4)]
    rows = turns.select("conv", "place", "bytes", *[p.alias(f"own_{n}") for n, p in zip(names, parts)])
    bucket = F.floor(F.col("place") / chunk)
    summed = running(rows, ["conv"], bucket, ["place"], sums={
        **{n: F.col(f"own_{n}") for n in names}, "before": F.col("bytes")})
    name = lambda depth, sums: F.unhex(F.md5(F.concat_ws(",", depth, *sums).cast("binary")))
    step = F.struct(
        (F.col("place") + 1).alias("depth"), name(F.col("place") + 1, [F.col(n) + F.col(f"own_{n}") for n in names]).alias("key"),
        "before", (F.col("before") + F.col("bytes")).alias("upto"))
    above = F.when(F.col("place") == 0, _root()).otherwise(name(F.col("place"), [F.col(n) for n in names]))
    return summed.groupBy("conv", bucket.alias("chunk")).agg(
        F.min_by(above, "place").alias("above"), F.array_sort(F.collect_list(step)).alias("steps"))


class _Paths:
    """Written paths and their chunk size."""

    def __init__(self, rows: DataFrame, chunk: int):
        self.rows, self.chunk = rows, chunk

    def of(self, depth: Column) -> Column:
        return F.floor((depth - 1) / self.chunk).cast("long")

    def renamed(self, conv: str, chunk: str, *more: Column) -> DataFrame:
        return self.rows.select(F.col("conv").alias(conv), F.col("chunk").alias(chunk), *more)

    def look_up(self, rows: DataFrame, conv: str, wanted: dict[str, Column], fields: Sequence[str] = ("key",)) -> DataFrame:
        """``rows`` with the steps at the ``wanted`` depths of the path ``conv``; null where there is none."""
        for name, depth in wanted.items():
            asked = rows.withColumn("_depth", depth).withColumn("_chunk", self.of(F.col("_depth")))
            found = asked.join(self.renamed(conv, "_chunk", F.col("steps").alias("_steps")), [conv, "_chunk"], "left")
            step = F.try_element_at("_steps", ((F.col("_depth") - 1) % self.chunk + 1).cast("int"))
            rows = found.select(*rows.columns, *[step[f].alias(f"{name}_{f}") for f in fields])
        return rows

    def along(self, rows: DataFrame, conv: str, low: Column, high: Column) -> DataFrame:
        """``rows`` once for each step of the path ``conv`` from below ``low`` to ``high``; the step and the name above it."""
        cut = rows.withColumn("_low", low).withColumn("_high", high).filter("_low < _high")
        each = cut.withColumn("_chunk", F.explode(F.sequence(self.of(F.col("_low") + 1), self.of(F.col("_high")))))
        with_steps = each.join(self.renamed(conv, "_chunk", F.col("above").alias("_above"), F.col("steps").alias("_steps")), [conv, "_chunk"])
        above = F.transform("_steps", lambda s, i: F.when(i == 0, F.col("_above")).otherwise(F.col("_steps")[i - 1]["key"]))
        both = F.filter(F.arrays_zip(F.col("_steps").alias("step"), above.alias("above")), lambda z: (
            z["step"]["depth"] > F.col("_low")) & (z["step"]["depth"] <= F.col("_high")))
        return with_steps.select(*rows.columns, F.explode(both).alias("z")).select(*rows.columns, "z.step.*", "z.above")


# -- the trie -----------------------------------------------------------------------------

def _linked(rows: DataFrame, group: str, chunk: int) -> DataFrame:
    """Rows (group, depth, key, conv, start): with the next higher node of the group, or ``start`` (depth, key) above the first."""
    seen = running(rows, [group], F.floor(F.col("depth") / chunk), ["depth"], maxima={"_above": F.struct("depth", "key")})
    above = F.coalesce("_above", "start")
    return seen.select("key", "depth", above["depth"].alias("up"), above["key"].alias("up_key"), "conv")


def _handles(nodes: DataFrame, stored: _Paths) -> DataFrame:
    """Nodes but the root, with the names at their handle and at the top of their edge."""
    asked = nodes.filter("depth > 0").withColumn("handle", fattest(F.col("up"), F.col("depth")))
    return stored.look_up(asked, "conv", {"handle": F.col("handle"), "top": F.col("up") + 1})


def locate(found: DataFrame, nodes: DataFrame, stored: _Paths) -> DataFrame:
    """Where paths (conv, end, size) leave the trie: depth ``exit`` on the edge of ``edge``, a node's key.

    ``exit`` at that node's own depth means that the path leaves at the node.
    """
    size = stored.chunk
    table_ = materialize(_handles(nodes, stored), "handles")
    by_handle = table_.select(F.col("handle_key").alias("_probe"), F.col("key").alias("_node"), F.col("depth").alias("_node_depth"))
    marks = stored.rows.filter(F.size("steps") == size).groupBy("conv").agg(F.array_sort(F.collect_list(
        F.struct("chunk", F.col("steps")[size - 1]["key"].alias("key")))).alias("marks"))
    state = found.select("conv", "end", "size", F.lit(0).cast("long").alias("low"), F.col("size").alias("high"), _root().alias("node"))

    def search(state: DataFrame, open_: Column, name: Column, carried: str) -> DataFrame:
        """Probe until ``open_`` holds for no row; ``name`` is the prefix to look for."""
        done, probe = [], fattest(F.col("low"), F.col("high"))
        state = materialize(state, "search")
        while not state.filter(open_).isEmpty():
            done.append(state.filter(~open_).drop(carried))
            asked = state.filter(open_).withColumn("_f", probe).withColumn("_probe", name)
            hit = F.col("_node").isNotNull()
            state = materialize(asked.join(by_handle, "_probe", "left").select(
                "conv", "end", "size", F.when(hit, F.col("_node_depth")).otherwise(F.col("low")).alias("low"),
                F.when(hit, F.col("high")).otherwise(F.col("_f") - 1).alias("high"),
                F.when(hit, F.col("_node")).otherwise(F.col("node")).alias("node"), carried), "search")
        out = state.drop(carried)
        for part in done:
            out = out.unionByName(part)
        return out

    place = F.floor(F.col("high") / size) * size
    coarse = search(
        state.join(marks, "conv", "left"), (F.col("low") < F.col("high")) & (place > F.col("low")),
        F.col("marks")[F.floor(F.col("_f") / size).cast("int") - 1]["key"], "marks")
    chunks = stored.renamed("conv", "_chunk", F.transform("steps", lambda s: s["key"]).alias("keys"))
    fine = search(
        coarse.withColumn("_chunk", stored.of(F.col("high"))).join(chunks, ["conv", "_chunk"], "left").drop("_chunk"),
        F.col("low") < F.col("high"), F.col("keys")[((F.col("_f") - 1) % size).cast("int")], "keys")

    # The last node found may agree at its handle only; else the next edge begins below it.
    deepest = fine.select("conv", "end", "size", F.col("node").alias("at"), F.col("low").alias("at_depth"))
    named = materialize(stored.look_up(deepest, "conv", {"at": F.col("at_depth"), "next": F.col("at_depth") + 1}), "deepest")
    whole = (F.col("at_depth") == 0) | F.coalesce(F.col("at_key") == F.col("at"), F.lit(False))
    edges = table_.select(F.col("key").alias("edge"), F.col("depth").alias("edge_depth"), F.col("conv").alias("other"), "handle", "top_key")
    below = named.filter(whole).join(edges.withColumnRenamed("top_key", "next_key"), "next_key", "left").select(
        "conv", "end", "size", F.coalesce("edge", "at").alias("edge"), F.coalesce("edge_depth", "at_depth").alias("edge_depth"),
        "other", F.when(F.col("edge").isNull(), F.col("at_depth")).otherwise(F.col("at_depth") + 1).alias("low"))
    inside = named.filter(~whole).join(edges.withColumnRenamed("edge", "at"), "at").select(
        "conv", "end", "size", F.col("at").alias("edge"), "edge_depth", "other", F.col("handle").alias("low"))
    reached = materialize(below.unionByName(inside), "edges")

    # Names agree down to the exit and nowhere below it.
    high = F.least("size", "edge_depth")
    open_edges = reached.filter((F.col("low") < high) & F.col("other").isNotNull()).select("conv", "other", "low", high.alias("high"))
    spans = open_edges.withColumn("_chunk", F.explode(F.sequence(stored.of(F.col("low") + 1), stored.of(F.col("high")))))
    compared = spans.join(stored.renamed("conv", "_chunk", F.col("steps").alias("mine")), ["conv", "_chunk"]).join(
        stored.renamed("other", "_chunk", F.col("steps").alias("theirs")), ["other", "_chunk"])
    same = F.size(F.filter(F.arrays_zip("mine", "theirs"), lambda z: (
        z["mine"]["key"] == z["theirs"]["key"]) & (z["mine"]["depth"] > F.col("low")) & (z["mine"]["depth"] <= F.col("high"))))
    agreed = compared.groupBy("conv").agg(F.sum(same).alias("same"))
    return reached.join(agreed, "conv", "left").select(
        "conv", "end", "size", "edge", "edge_depth", (F.col("low") + F.coalesce("same", F.lit(0))).alias("exit"))


def insert(nodes: DataFrame, located: DataFrame, stored: _Paths) -> DataFrame:
    """The nodes after a batch of located paths."""
    located = materialize(located, "located")
    new = materialize(stored.along(located.select("conv", "end", "exit", "size"), "conv", F.col("exit"), F.col("size")), "new-steps")
    known = new.groupBy("key").agg(F.min("above").alias("above"))
    branches = known.groupBy("above").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("above").alias("key"))
    ends = located.filter("exit < size").select(F.col("end").alias("key"))
    compact = branches.unionByName(ends).distinct()
    leaving = new.filter(F.col("depth") == F.col("exit") + 1).select("conv", F.struct(F.col("exit").alias("depth"), F.col("above").alias("key")).alias("start"))
    marked = new.join(compact, "key").join(leaving, "conv").select("conv", "depth", "key", "start")
    grown = _linked(marked.withColumn("path", F.col("conv")), "path", stored.chunk)
    grown = grown.groupBy("key").agg(*[F.min_by(c, "conv").alias(c) for c in ("depth", "up", "up_key")], F.min("conv").alias("conv"))

    # Edges that a path leaves midway, or on which it ends.
    midway = located.filter("exit < edge_depth").join(
        leaving.select("conv", F.col("start")["key"].alias("left_at")), "conv", "left").select(
        "edge", F.col("exit").alias("depth"), F.coalesce("left_at", "end").alias("key"), "conv")
    splits = midway.groupBy("edge", "depth").agg(F.min("key").alias("key"), F.min("conv").alias("conv"))
    cut = nodes.join(splits.select(F.col("edge").alias("key")).distinct(), "key", "left_semi")
    points = splits.join(cut.select(F.col("key").alias("edge"), F.struct(F.col("up").alias("depth"), F.col("up_key").alias("key")).alias("start")), "edge")
    points = points.unionByName(cut.select(
        F.col("key").alias("edge"), "depth", "key", "conv", F.struct(F.col("up").alias("depth"), F.col("up_key").alias("key")).alias("start")))
    again = _linked(points.select("edge", "depth", "key", "conv", "start"), "edge", stored.chunk)
    kept = nodes.join(cut.select("key"), "key", "left_anti")
    columns = ["key", "depth", "up", "up_key", "conv"]
    return materialize(kept.select(columns).unionByName(again.select(columns)).unionByName(grown.select(columns)), "nodes")


def build(classes: DataFrame, stored: _Paths, batches: Sequence[float] = BATCHES) -> DataFrame:
    """(key, depth, up, up_key, conv): compacted nodes; a path ``conv`` runs through each."""
    spark = classes.sparkSession
    nodes = spark.range(1).select(
        _root().alias("key"), F.lit(0).cast("long").alias("depth"), F.lit(-1).cast("long").alias("up"),
        F.lit(None).cast("binary").alias("up_key"), F.lit(None).cast("long").alias("conv"))
    drawn = F.pmod(F.xxhash64("end"), F.lit(1 << 20)) / (1 << 20)
    before = 0.0
    for number, share in enumerate(batches):
        batch = classes.filter((drawn >= before) & (drawn < share)).select("conv", "end", "size")
        located = locate(batch, nodes, stored) if number else batch.select(
            "*", _root().alias("edge"), F.lit(0).cast("long").alias("edge_depth"), F.lit(0).cast("long").alias("exit"))
        nodes, before = insert(nodes, located, stored), share
    return nodes


# -- what nodes hold ------------------------------------------------------------------------

def _ends_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the ids that end at each name; ids are sorted in parts and hashed as a stream."""
    part = F.floor(F.col("conv") / _IDS)
    written = F.when(F.col("conv") == NULL_ID, "null").otherwise(F.col("conv").cast("string"))
    parts = ends.groupBy("end", part.alias("part")).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("conv", written.alias("written")))), lambda x: x["written"]), ",").alias("ids"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, out = None, None, []
        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if name != last:
                    if last is not None:
                        out.append((last, state.hexdigest()))
                    last, state = name, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield _two(out)
                out = []
        if last is not None:
            yield _two([(last, state.hexdigest())])

    return parts.repartition("end").sortWithinPartitions("end", "part").mapInArrow(run, "key binary, ends_sha256 string")


def _two(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    keys, digests = zip(*rows)
    return pa.record_batch([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], ["key", "ends_sha256"])


SUMS = ("n", "leaves", "weighted", "bytes")


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """Sums and the least ``first`` over all subtrees of nodes (key, up_key, first, *SUMS).

    After round i a node has the sums of what lies fewer than 2^i levels below
    it, and points 2^i levels up; so the rounds are the logarithm of the height.
    """
    state = materialize(nodes.withColumn("jump", F.col("up_key")), "subtrees")
    while not state.filter("jump is not null").isEmpty():
        moving = state.filter("jump is not null")
        more = moving.groupBy(F.col("jump").alias("key")).agg(
            F.min("first").alias("_first"), *[F.sum(c).alias(f"_{c}") for c in SUMS])
        next_ = moving.select("key", "jump").join(
            state.select(F.col("key").alias("jump"), F.col("jump").alias("_jump")), "jump").select("key", "_jump")
        state = materialize(state.join(more, "key", "left").join(next_, "key", "left").select(
            "key", "up_key", F.least("first", "_first").alias("first"),
            *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in SUMS], F.col("_jump").alias("jump")), "subtrees")
    return state.drop("jump")


def prefix_nodes(df: DataFrame, chunk: int = CHUNK, batches: Sequence[float] = BATCHES) -> DataFrame:
    """A row for each distinct sequence of first turns of the rebuilt conversations."""
    ship_package(df.sparkSession)
    turns, convs = rebuilt(df)
    every = materialize(paths(turns, chunk), "paths")
    last = every.groupBy("conv").agg(F.max_by(F.element_at("steps", -1), "chunk").alias("last"))
    ends = materialize(convs.select("conv").join(last, "conv", "left").select(
        "conv", F.coalesce(F.col("last.key"), _root()).alias("end"), F.coalesce("last.depth", F.lit(0)).alias("size"),
        F.coalesce("last.upto", F.lit(0)).alias("upto")), "ends")
    classes = materialize(ends.groupBy("end").agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n"), F.min("size").alias("size"), F.min("upto").alias("upto")), "classes")
    stored = _Paths(materialize(every.join(classes.select("conv"), "conv", "left_semi"), "paths"), chunk)
    nodes = build(classes, stored, batches)

    # Of a node: its own members, text from the root on, and what its edge adds.
    seen = stored.look_up(nodes, "conv", {"own": F.col("depth"), "above": F.col("up")}, ["upto"]).select(
        "key", "depth", "up", "up_key", "conv", F.coalesce("own_upto", F.lit(0)).alias("upto"), F.coalesce("above_upto", F.lit(0)).alias("above_upto"))
    children = nodes.filter("up_key is not null").groupBy(F.col("up_key").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    members = classes.select(F.col("end").alias("key"), F.col("conv").alias("first"), "n")
    full = materialize(seen.join(children, "key", "left").join(members, "key", "left").select(
        *seen.columns, F.coalesce("n_children", F.lit(0)).alias("n_children"), "first", F.coalesce("n", F.lit(0)).alias("n")), "full-nodes")
    sums = subtree_sums(full.select(
        "key", "up_key", "first", "n", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"),
        (F.col("n") * F.col("upto")).alias("weighted"), (F.col("upto") - F.col("above_upto")).alias("bytes")))
    upper = sums.select(F.col("key").alias("up_key"), F.col("first").alias("up_first"))
    done = full.drop("first", "n").join(sums.drop("up_key"), "key").join(upper, "up_key", "left").join(
        _ends_digests(ends), "key", "left").filter("n > 0")
    nothing = hashlib.sha256(b"").hexdigest()
    # Of a place on an edge: everything below the edge's end, and the rest of the edge.
    below = F.col("bytes") - (F.col("upto") - F.col("above_upto"))
    saved = lambda before: F.col("weighted") - F.col("n") * before - below - (F.col("upto") - before)
    at_end = lambda depth: depth == F.col("depth")
    columns = lambda depth, before: [
        unkey("first").alias("conv_id"), depth.alias("depth"),
        F.when(depth == F.col("up") + 1, unkey("up_first")).otherwise(unkey("first")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(at_end(depth), F.col("n_children")).otherwise(1).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"), saved(before).alias("saved_tokens"),
        F.when(at_end(depth), F.coalesce("ends_sha256", F.lit(nothing))).otherwise(nothing).alias("ends_sha256")]
    edges = stored.along(done.filter("depth > 0").withColumnRenamed("key", "node").withColumnsRenamed({"depth": "end_depth", "upto": "end_upto"}),
                         "conv", F.col("up"), F.col("end_depth"))
    edges = edges.withColumnsRenamed({"depth": "step_depth", "upto": "step_upto", "end_depth": "depth", "end_upto": "upto"})
    top = done.filter("depth = 0").withColumn("up_first", F.lit(None).cast("long"))
    return edges.select(columns(F.col("step_depth"), F.col("before"))).unionByName(
        top.select(columns(F.col("depth"), F.lit(0).cast("long"))).withColumn("parent_conv_id", F.lit(None).cast("long")))


@query("op12_prefix_trie")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the rebuilt conversations."""
    return prefix_nodes(table(spark, sf_dir, "conversations"))
