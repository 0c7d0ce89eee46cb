"""Random forests: the upper levels from histograms, lower subtrees each in one task.

All trees of all fits grow at once. While a node has many rows, a level is one
pass of sums per (node, feature, bin), as in boosting. A node whose binned rows fit
into a task (``LOCAL_ROWS``, fewer if rows are wide) is finished there: one
shuffle by (fit, tree, node) brings them together, and the subtree is
written. Subtrees never come to the driver unless the forest is small; rows to be predicted
go where the subtrees are. So the number of passes follows from the binned rows over ``LOCAL_ROWS``, not
from the depth, and depths of 100 and leaves of one row are grown as asked.

A tree sees rows by their bins only, so rows that are binned alike are summed (label, weight, rows) before they
travel, and predicted once. The binned table is written in the order of its bins for that. Where all rows
differ, each travels on its own, as many as there are. Sums are of whole numbers of a small unit, hence exact in any order.

Bootstrap counts are Poisson(1) numbers from a hash of the row's key and the
tree, and features are drawn for each node by a hash of its path, so that a lost task
draws the same again and both ways of growing give the same tree. Rows that
repeat a key are drawn together. ``min_samples_split`` and ``min_samples_leaf`` count
different drawn rows. ``max_features`` features are drawn among those that are
not constant in the node. Only entries above a feature's first bin are
visited; the first bin is the node's total less the others, so one-hot columns cost
what their ones cost. Splits must gain more than rounding; equal gains go to the
first feature, then the first bin.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Any, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from nestfold.models.boost import MAX_FITS, NUMBERS, uniform
from nestfold.models.hist import MAX_BINS, MAX_LEAVES, Bins, above, binned, bins_of, nodes_of, quantile_cuts
from nestfold.models.passes import append_columns, sum_over_rows
from nestfold.sources.storage import fresh_path, materialize

LOCAL_ROWS = 500_000  # different binned rows of a node that one task finishes
LOCAL_BYTES = 128 << 20  # of these rows
CHUNK = 100_000  # rows that a task deals to nodes at once
MOST_FILES = 10_000  # of the rows put side by side
LEAST_FILE = 5_000  # rows of these files
TREES_AT_ONCE = 64  # trees whose rows are shuffled in one job, at least
JOB_BYTES = 2 << 30  # of binned rows that a job of more trees shuffles
BATCH_BYTES = 4 << 20  # of binned rows that a task passes on at once
ROUNDING = 1e-10  # share of a node's score that a split must gain
HELD_NODES = 500_000  # of a forest that goes whole to the driver and the tasks that predict; larger ones are met by their rows
SCORED_ROWS = 10_000  # rows of a chunk that a larger forest predicts
PARTS = "fit int, tree int, node int, a binary, b binary, c binary, d binary"  # subtrees, packed
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])
UNSURE = 255
_EDGES = np.arange((1 << 16) + 1) / (1 << 16)
# Draws by the first 16 bits of a number; ranges that hold a step are looked up.
DRAWS = np.where(np.searchsorted(POISSON, _EDGES[:-1], "right") == np.searchsorted(POISSON, _EDGES[1:], "left"),
                 np.searchsorted(POISSON, _EDGES[:-1], "right"), UNSURE).astype(np.uint8)

Packed = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # feature (-1: a leaf), bin, left child, value


@dataclass(frozen=True)
class Settings:
    n_estimators: int = 100
    max_depth: int = 100
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    max_features: str = "auto"  # "auto": all of them

    def __post_init__(self):
        if self.max_features not in ("sqrt", "auto"):
            raise ValueError(f"no rule {self.max_features!r} for features per node")
        for name, least in (("n_estimators", 1), ("max_depth", 0), ("min_samples_split", 2), ("min_samples_leaf", 1)):
            if getattr(self, name) < least:
                raise ValueError(f"{name} must be {least} at least")

    @classmethod
    def of(cls, params: Mapping[str, Any]) -> Settings:
        whole = {n: int(params[n]) for n in ("n_estimators", "max_depth", "min_samples_split", "min_samples_leaf") if params.get(n) is not None}
        return cls(**whole, max_features=str(params.get("max_features") or "auto"))

    def drawn(self, n_features: int) -> int:
        return max(1, math.isqrt(n_features)) if self.max_features == "sqrt" else n_features

    def open(self, rows: np.ndarray, depth: int) -> np.ndarray:
        """Whether nodes of so many rows may be split at all."""
        return (rows >= max(self.min_samples_split, 2 * self.min_samples_leaf)) & (depth < self.max_depth)


@dataclass(frozen=True)
class Fit:
    """One forest: its settings, its training rows, and the scale (a * label + b) its predictions have."""

    settings: Settings
    train: Column
    scale: tuple[float, float] = (1.0, 0.0)


@dataclass
class Forest:
    """Trees over binned features; a prediction is the average of their leaves.

    The driver has the upper levels (``tops``) only. Subtrees below them stay in a written
    table, as there are as many of their nodes as training rows and trees.
    """

    bins: Bins
    tops: list[Packed]
    scale: tuple[float, float, float]  # a, b and the middle: a tree's value v predicts a * (v + middle) + b
    parts: DataFrame | None = None  # (tree, node, a, b, c, d): the subtree that takes the place of a top's leaf
    n_nodes: int = 0

    @property
    def trees(self) -> list[Packed]:
        """Whole trees, in the scale of the predictions, for forests that fit into the driver."""
        found: dict[int, dict[int, Packed]] = {}
        for r in self.parts.collect() if self.parts is not None else ():
            found.setdefault(r.tree, {})[r.node] = _unpacked(r.a, r.b, r.c, r.d)
        whole = [_graft(top, found.get(i, {})) for i, top in enumerate(self.tops)]
        return [(*tree[:3], _scaled(tree[3], self.scale)) for tree in whole]

    def predict_arrays(self, x: np.ndarray) -> np.ndarray:
        return _average(self.trees, self.bins.of(x))

    def predict(self, df: DataFrame, keep: Sequence[str], features: str = "features") -> DataFrame:
        if self.n_nodes > HELD_NODES:
            return self._predict_by_parts(df, keep, features)
        shared = df.sparkSession.sparkContext.broadcast((self.bins, self.trees))

        def compute(x: np.ndarray) -> dict[str, np.ndarray]:
            bins, trees = shared.value
            return {"pred_mean": _average(trees, bins.of(x))}

        return append_columns(df, features, keep, compute, "pred_mean double")

    def _predict_by_parts(self, df: DataFrame, keep: Sequence[str], features: str) -> DataFrame:
        """Binned rows go to the subtrees they reach in each tree, each once, and the leaves' values come back to be averaged.

        They travel as packed blocks of a written chunk; a task holds one subtree and one
        block at a time, or one chunk's values.
        """
        width, n_trees, scale = len(self.bins.cuts), len(self.tops), self.scale
        spark, packed = df.sparkSession, _free("_bins", keep)
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
        scored_rows = materialize(binned(df, self.bins, keep, features).withColumnRenamed("bins", packed), "scored")
        chunk, place = "chunk", "place"
        different = scored_rows.select(F.col(packed).alias("bins")).distinct()
        rows = materialize(_chunked(different.repartition(n, "bins"), [], chunk, place, packed), "chunks")
        shared = spark.sparkContext.broadcast(self.tops)

        def route(stream):
            for batch in stream:
                if not batch.num_rows:
                    continue
                binned_rows = bins_of(batch.column(packed), width)
                of, at = batch.column(chunk).to_numpy(), batch.column(place).to_numpy()
                for tree, top in enumerate(shared.value):
                    node = nodes_of(top, binned_rows)
                    order = np.lexsort((of, node))
                    edges = np.flatnonzero((np.diff(node[order]) != 0) | (np.diff(of[order]) != 0)) + 1
                    blocks = np.split(order, edges)
                    yield pa.record_batch([
                        pa.array([tree] * len(blocks), pa.int32()), pa.array([node[u[0]] for u in blocks], pa.int32()),
                        pa.array([of[u[0]] for u in blocks], pa.int64()),
                        *[pa.array([a[u].tobytes() for u in blocks], pa.binary()) for a in (at, binned_rows)]],
                        ["tree", "node", "chunk", "at", "bins"])

        def apply(stream):
            key, part = None, None
            for batch in stream:
                tree, node, chunks = (batch.column(c).to_pylist() for c in ("tree", "node", "chunk"))
                sub, at, bins = ([batch.column(c) for c in names] for names in (("a", "b", "c", "d"), ("at",), ("bins",)))
                made = []
                for i in range(batch.num_rows):
                    if key != (tree[i], node[i]):
                        key, part = (tree[i], node[i]), None
                    if chunks[i] is None:  # sorted before the blocks
                        part = _unpacked(*(c[i].as_buffer() for c in sub))
                        continue
                    block = np.frombuffer(bins[0][i].as_buffer(), np.uint8).reshape(-1, width)
                    top = shared.value[tree[i]]
                    value = np.full(len(block), top[3][node[i]]) if part is None else part[3][nodes_of(part, block)]
                    made.append((tree[i], chunks[i], at[0][i], _scaled(value, scale).tobytes()))
                if made:
                    yield pa.record_batch([
                        pa.array([m[0] for m in made], pa.int32()), pa.array([m[1] for m in made], pa.int64()),
                        pa.array([m[2].as_py() for m in made], pa.binary()), pa.array([m[3] for m in made], pa.binary())],
                        ["tree", "chunk", "at", "value"])

        def add(group: pa.Table) -> pa.Table:
            group = group.sort_by("tree")  # so that sums do not depend on how blocks arrive
            at = [np.frombuffer(v.as_buffer(), np.int32) for v in group.column("at")]
            out = np.zeros(max(int(a.max()) for a in at) + 1)
            for places, value in zip(at, group.column("value")):
                out[places] += np.frombuffer(value.as_buffer(), np.float64)
            return pa.table({chunk: pa.array([group.column("chunk")[0].as_py()] * len(out), pa.int64()),
                             place: pa.array(np.arange(len(out)), pa.int32()), "pred_mean": pa.array(out / n_trees)})

        blocks = rows.select(chunk, place, packed).mapInArrow(route, "tree int, node int, chunk long, at binary, bins binary")
        if self.parts is not None:
            blocks = self.parts.unionByName(blocks, allowMissingColumns=True)
        else:
            blocks = blocks.select("*", *[F.lit(None).cast("binary").alias(c) for c in "abcd"])
        met = blocks.repartition(n, "tree", "node").sortWithinPartitions("tree", "node", F.col("chunk").asc_nulls_first())
        values = met.mapInArrow(apply, "tree int, chunk long, at binary, value binary")
        scored = values.groupBy("chunk").applyInArrow(add, f"`{chunk}` long, `{place}` int, pred_mean double")
        known = rows.join(scored, [chunk, place]).select(packed, "pred_mean")
        return scored_rows.join(known, packed).select(*keep, "pred_mean")


def _free(name: str, taken: Sequence[str]) -> str:
    while name in taken:
        name = "_" + name
    return name


def _chunked(rows: DataFrame, keep: Sequence[str], chunk: str, place: str, packed: str) -> DataFrame:
    """Binned rows with the number of the chunk they are in, and their place there."""
    def task(stream):
        first = TaskContext.get().partitionId() << 32
        for batch in stream:
            for start in range(0, batch.num_rows, SCORED_ROWS):
                some = batch.slice(start, SCORED_ROWS)
                yield pa.record_batch(
                    [*[some.column(k) for k in keep], some.column("bins"), pa.array(np.full(some.num_rows, first), pa.int64()),
                     pa.array(np.arange(some.num_rows), pa.int32())], [*keep, packed, chunk, place])
                first += 1

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields)
    return rows.mapInArrow(task, f"{types}{', ' if types else ''}`{packed}` binary, `{chunk}` long, `{place}` int")


def _unpacked(a, b, c, d) -> Packed:
    return (*(np.frombuffer(v, np.int32) for v in (a, b, c)), np.frombuffer(d, np.float64))


def _scaled(value: np.ndarray, scale: tuple[float, float, float]) -> np.ndarray:
    a, b, middle = scale
    return a * (value + middle) + b


def _average(trees: Sequence[Packed], rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows))
    for tree in trees:
        out += tree[3][nodes_of(tree, rows)]
    return out / len(trees)


def bootstrap(ids: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often a tree draws each row."""
    u = uniform(ids, seed, tree)
    out = DRAWS[(u * len(DRAWS)).astype(np.int32)]
    unsure = np.flatnonzero(out == UNSURE)
    out[unsure] = np.searchsorted(POISSON, u[unsure], side="right")
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    return (uniform(x.view(np.int64), 1, 1) * 2.0 ** 53).astype(np.uint64)


def root_path(seed: int, tree: int) -> np.ndarray:
    return _mixed(np.array([seed * 1_000_003 + tree], np.uint64))


def child_paths(paths: np.ndarray) -> np.ndarray:
    """Paths of the left and the right children, in turn."""
    return _mixed(np.repeat(paths, 2) * np.uint64(2) + np.tile(np.arange(2, dtype=np.uint64), len(paths)))


def _score(label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return np.divide(label ** 2, weight, out=np.zeros(len(weight)), where=weight > 0)


@dataclass
class Choice:
    """The best split of each node: its feature (-1: none) and bin, and the sums on the left."""

    feature: np.ndarray
    bin: np.ndarray
    left: list[np.ndarray]
    constant: np.ndarray  # cells of features that do not vary in their node


def choose(node: np.ndarray, place: np.ndarray, sums: Sequence[np.ndarray], totals: Sequence[np.ndarray], bins: Bins, paths: np.ndarray,
           least: np.ndarray, drawn: np.ndarray, unit: float = 1.0) -> Choice:
    """Best splits from cells (node, bin) above the features' first bins, in order.

    ``sums`` and ``totals`` (per node) are weighted label (in ``unit``), weight, rows, and what else is to be known
    of the left sides; ``least`` rows must lie on both sides, and ``drawn`` features are tried.
    """
    n_nodes, n_features = len(totals[0]), len(bins.cuts)
    out = Choice(np.full(n_nodes, -1), np.zeros(n_nodes, np.int64), [np.zeros_like(t) for t in totals], np.zeros(len(node), bool))
    if not len(node):
        return out
    # A feature without entries above its first bin is constant in the node and needs no cells.
    feature = np.repeat(np.arange(n_features), bins.sizes)[place]
    new = np.ones(len(node), bool)
    new[1:] = (node[1:] != node[:-1]) | (feature[1:] != feature[:-1])
    start = np.flatnonzero(new)
    size, owner = np.diff(start, append=len(node)), node[start]

    def below(i: int) -> tuple[np.ndarray, np.ndarray]:
        """Of a feature's first bin, and of all its bins below each cell's."""
        first = totals[i][owner] - np.add.reduceat(sums[i], start)
        before = np.cumsum(sums[i]) - sums[i]
        return first, before + np.repeat(first - before[start], size)

    first, rows = below(2)
    out.constant[start[(size == 1) & (first < 0.5)]] = True
    ok = (rows > least[node] - 0.5) & (totals[2][node] - rows > least[node] - 0.5)
    if (drawn < n_features).any():
        # The first features by a hash of path and feature, among those that vary.
        vary = np.flatnonzero(size + (first > 0.5) > 1)
        at, what = owner[vary], feature[start[vary]]
        draw = _mixed(paths[at] ^ _mixed(what.astype(np.uint64)))
        rank = np.empty(len(vary), np.int64)
        rank[np.lexsort((draw, at))] = np.arange(len(vary)) - np.searchsorted(at, at)
        tried = np.zeros(len(start), bool)
        tried[vary[rank < drawn[at]]] = True
        ok &= np.repeat(tried, size)
    tested = np.flatnonzero(ok)
    label, weight = (below(i)[1][tested] for i in (0, 1))
    whole, at = _score(totals[0] * unit, totals[1]), node[tested]
    gain = _score(label * unit, weight) + _score((totals[0][at] - label) * unit, totals[1][at] - weight) - whole[at]
    good = gain > ROUNDING * whole[at]
    tested, at, gain = tested[good], at[good], gain[good]
    if not len(tested):
        return out
    begins = np.flatnonzero(np.diff(at, prepend=-1))
    best = np.maximum.reduceat(gain, begins)
    # Gains may differ by rounding; such gains are equal.
    top = np.flatnonzero(gain >= np.repeat(best - 1e-12 * (whole[at[begins]] + best), np.diff(begins, append=len(at))))
    top = top[np.diff(at[top], prepend=-1) != 0]
    nodes, cell = at[top], tested[top]
    out.feature[nodes] = feature[cell]
    out.bin[nodes] = np.where(new[cell], 0, place[cell - 1].astype(np.int64) - bins.offsets[feature[cell]])
    for i, left in enumerate(out.left):
        left[nodes] = below(i)[1][cell]
    return out


def _above(rows: np.ndarray, bins: Bins) -> tuple[np.ndarray, np.ndarray]:
    """Entries above the first bin: their rows and their places among all bins."""
    return above(rows, bins.offsets)


def grow(rows: np.ndarray, stats: Sequence[np.ndarray], bins: Bins, s: Settings, path: np.ndarray, depth: int, unit: float) -> Packed:
    """The whole tree over the binned rows that one task holds, level by level; child numbers follow the levels.

    ``stats`` are each binned row's weighted label (in ``unit``), weight and rows. Entries above the first bins are sorted once, by bin, and
    dealt to the children in that order, so that a level's cells are runs of them.
    """
    n_features, flat = rows.shape[1], rows.ravel()
    entry, place = _above(rows, bins)
    order = np.argsort(place.astype(np.uint16) if bins.offsets[-1] < 1 << 16 else place, kind="stable")
    entry, place = entry[order].astype(np.int32), place[order].astype(np.int32)
    totals, paths = [np.array([x.sum()]) for x in stats], path
    slots = np.flatnonzero(s.open(totals[2], depth))  # nodes of the level that may be split, in the order their entries have
    size = np.full(len(slots), len(entry))  # entries of each
    own, at = np.arange(len(rows)), np.zeros(len(rows), np.int32)  # rows in these nodes, and their slots
    turn = np.zeros(len(rows), np.uint8)  # 1: the row goes left, 2: right, 0: to a leaf
    levels, begin = [], 0  # of the level's nodes
    while True:
        n = len(totals[0])
        feature, cut, left = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
        levels.append((feature, cut, left, totals[0] * unit / totals[1]))
        if not len(slots):
            break
        ends = np.cumsum(size)
        new = np.ones(len(entry), bool)
        new[1:] = place[1:] != place[:-1]
        new[(ends - size)[size > 0]] = True
        start = np.flatnonzero(new)
        sums = [np.add.reduceat(x[entry], start) if len(start) else x[:0] for x in stats]
        best = choose(np.repeat(np.arange(len(slots)), size)[start], place[start], sums, [t[slots] for t in totals], bins, paths[slots],
                      np.full(len(slots), s.min_samples_leaf), np.full(len(slots), s.drawn(n_features)), unit)
        split = np.flatnonzero(best.feature >= 0)
        split = split[np.argsort(slots[split])]
        kept = slots[split]
        feature[kept], cut[kept] = best.feature[split], best.bin[split]
        left[kept] = begin + n + 2 * np.arange(len(kept))
        paths, begin, depth = child_paths(paths[kept]), begin + n, depth + 1
        if begin > 2 * MAX_LEAVES:
            raise ValueError(f"a tree has more than {MAX_LEAVES} leaves: raise min_samples_leaf or lower max_depth")
        if not len(kept):
            break
        totals = [np.stack([x[split], t[kept] - x[split]], axis=1).ravel() for x, t in zip(best.left, totals)]
        # Children that may be split: all left ones come first.
        child = np.full((2, len(slots)), -1)
        child[:, split] = np.arange(2 * len(split)).reshape(-1, 2).T
        child[:, split] = np.where(s.open(totals[2], depth)[child[:, split]], child[:, split], -1)
        goes_on = child >= 0
        slot = (np.cumsum(goes_on.ravel()) - 1).astype(np.int32).reshape(2, -1)
        side = (flat[own * n_features + np.maximum(best.feature[at], 0)] > best.bin[at]).astype(np.int8)
        on = goes_on[side, at]
        turn[own] = on * (1 + side)
        own, at = own[on], slot[side[on], at[on]]
        turned = turn[entry]
        turned[np.repeat(best.constant, np.diff(start, append=len(entry)))] = 0  # they stay constant below
        sides = [np.flatnonzero(turned == 1), np.flatnonzero(turned == 2)]
        size = np.concatenate([np.diff(np.searchsorted(u, ends), prepend=0)[g] for u, g in zip(sides, goes_on)])
        slots = child[goes_on]
        both = np.concatenate(sides)
        entry, place = entry[both], place[both]
    f, c, l, v = (np.concatenate(a) for a in zip(*levels))
    return f.astype(np.int32), c.astype(np.int32), l.astype(np.int32), v


class _Growing:
    """A tree whose upper levels the driver knows: nodes, their paths, depths and sums."""

    def __init__(self, path: np.ndarray):
        self.feature, self.bin, self.left, self.value, self.depth, self.path = [-1], [0], [0], [0.0], [0], [path]

    def split(self, node: int, feature: int, bin_: int, sums: np.ndarray) -> tuple[int, int]:
        first = len(self.feature)
        if first > 2 * MAX_LEAVES:
            raise ValueError(f"the upper levels of a tree have more than {MAX_LEAVES} leaves: raise local_rows, min_samples_leaf or lower max_depth")
        self.feature[node], self.bin[node], self.left[node] = feature, bin_, first
        for path, part in zip(np.split(child_paths(self.path[node]), 2), sums):
            for column, v in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.value, part[0] / part[1]), (self.depth, self.depth[node] + 1), (self.path, path)):
                column.append(v)
        return first, first + 1

    def packed(self) -> Packed:
        return np.array(self.feature, np.int32), np.array(self.bin, np.int32), np.array(self.left, np.int32), np.array(self.value)


def _graft(top: Packed, parts: Mapping[int, Packed]) -> Packed:
    """``top`` with subtrees in the places of some of its leaves."""
    columns = [[c] for c in top]
    columns[0][0], size = top[0].copy(), len(top[0])
    for node, sub in sorted(parts.items()):
        left = np.where(sub[0] >= 0, sub[2] + size - 1, 0)  # the subtree's second node comes first behind
        for column, own in zip(columns, (sub[0], sub[1], left, sub[3])):
            column[0][node] = own[0]
            column.append(own[1:])
        size += len(sub[0]) - 1
    feature, bin_, left, value = (np.concatenate(c) for c in columns)
    return feature, bin_, left.astype(np.int32), value


def _chunks(stream: Iterator[pa.RecordBatch], n_features: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, labels, training bits, bins) of about ``CHUNK`` rows at a time."""
    held, size = [], 0
    for batch in stream:
        if batch.num_rows:
            held.append((*(batch.column(c).to_numpy() for c in ("id", "label", "train")), bins_of(batch.column("bins"), n_features)))
            size += batch.num_rows
        if size >= CHUNK:
            yield tuple(np.concatenate(c) for c in zip(*held))
            held, size = [], 0
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


def _weighed(stream: Iterator[pa.RecordBatch], n_features: int, fits_of: Mapping[int, Sequence[int]], seed: int) -> Iterator[tuple[int, int, np.ndarray, list[np.ndarray]]]:
    """For each chunk and tree, and the fits it is grown for: the binned rows it draws, each once, and their weighted labels, weights and rows.

    Rows that are binned alike are summed where they follow each other. The fits that share a tree share its draws.
    """
    for ids, label, train, rows in _chunks(stream, n_features):
        other = np.ones(len(rows), bool)
        other[1:] = (rows[1:] != rows[:-1]).any(axis=1)
        run = other.copy()
        run[1:] |= train[1:] != train[:-1]
        start = np.flatnonzero(run)
        used, of = train[start], np.cumsum(other)[start] - 1
        rows = rows[other]
        members = {fit: np.flatnonzero(used >> fit & 1) for fit in {f for fits in fits_of.values() for f in fits}}
        for tree, fits in fits_of.items():
            weight = bootstrap(ids, seed, tree)
            drawn = weight > 0
            weight = weight.astype(np.int64)
            weighted = weight * label if label.dtype.kind == "i" else np.where(drawn, weight * label, 0)
            sums = [np.add.reduceat(x, start) for x in (weighted, weight, drawn.astype(np.int64))]
            for fit in fits:
                mine = members[fit]
                mine = mine[sums[2][mine] > 0]
                if len(mine):
                    first = np.flatnonzero(np.diff(of[mine], prepend=-1))
                    yield fit, tree, rows[of[mine[first]]], [np.add.reduceat(x[mine], first) for x in sums]


def _fits_of(pairs: Sequence[tuple[int, int]]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for fit, tree in pairs:
        out.setdefault(tree, []).append(fit)
    return out


def _level_pass(rows: DataFrame, bins: Bins, trees: Mapping[tuple[int, int], Packed], nodes: Sequence[tuple[int, int, int]], seed: int, unit: float) -> np.ndarray:
    """(node, bin, (weighted label, weight, rows, binned rows)) above the first bins; the last bin holds the node's totals.

    Binned rows are counted once where they follow each other, as they are when a task finishes the node.
    """
    total, width = int(bins.offsets[-1]), len(bins.cuts)
    places: dict[tuple[int, int], dict[int, int]] = {}
    for at, (fit, tree, node) in enumerate(nodes):
        places.setdefault((fit, tree), {})[node] = at
    shared = rows.sparkSession.sparkContext.broadcast((bins, {k: trees[k] for k in places}, places))

    def task(stream):
        cuts, tops, where = shared.value
        out = np.zeros((len(nodes), total + 1, 4))
        for fit, tree, cells, sums in _weighed(stream, width, _fits_of(list(where)), seed):
            own = where[fit, tree]
            place = np.full(len(tops[fit, tree][0]), -1)
            place[list(own)] = list(own.values())
            node = place[nodes_of(tops[fit, tree], cells)]
            use = np.flatnonzero(node >= 0)
            first, n, node = min(own.values()), len(own), node[use]
            row, at = _above(cells[use], cuts)
            key = np.concatenate([(node[row] - first) * (total + 1) + at, (node - first) * (total + 1) + total])
            each = np.concatenate([row, np.arange(len(use))])
            for i, x in enumerate((sums[0][use] * unit, sums[1][use], sums[2][use], np.ones(len(use)))):
                out[first:first + n, :, i] += np.bincount(key, x[each], n * (total + 1)).reshape(n, -1)
        return out.ravel()

    size = len(nodes) * (total + 1) * 4
    return sum_over_rows(rows, ["id", "label", "train", "bins"], task, size, shared).reshape(len(nodes), total + 1, 4)


def _finish(rows: DataFrame, bins: Bins, fits: Sequence[Fit], tops: Mapping[tuple[int, int], _Growing],
            nodes: Sequence[tuple[int, int, int]], seed: int, unit: float) -> str:
    """Subtrees below ``nodes``, each from one task that gets all of the node's binned rows; gives the path they are written to."""
    width = len(bins.cuts)
    wanted: dict[tuple[int, int], list[int]] = {}
    for fit, tree, node in nodes:
        wanted.setdefault((fit, tree), []).append(node)
    spark = rows.sparkSession
    kind = np.int64 if dict(rows.dtypes)["label"] == "bigint" else np.float64
    shared = spark.sparkContext.broadcast((
        bins, [f.settings for f in fits], {k: tops[k].packed() for k in wanted}, wanted,
        {(*k, n): (tops[k].path[n], tops[k].depth[n]) for k, own in wanted.items() for n in own}))
    names = ["fit", "tree", "node", "label", "weight", "rows", "bins"]

    def deal(stream):
        _, _, trees, where, _ = shared.value
        held, size = [], 0
        for fit, tree, cells, sums in _weighed(stream, width, _fits_of(list(where)), seed):
            own = where[fit, tree]
            node = nodes_of(trees[fit, tree], cells)
            order = np.argsort(node, kind="stable")
            node = node[order]
            for n in own:
                a, b = np.searchsorted(node, [n, n + 1])
                if b > a:
                    use = order[a:b]
                    held.append((fit, tree, n, sums[0][use].tobytes(), *(x[use].astype(np.int32).tobytes() for x in sums[1:]), cells[use].tobytes()))
                    size += (b - a) * (width + 16)
                    if size >= BATCH_BYTES:
                        yield _records(held, names)
                        held, size = [], 0
        if held:
            yield _records(held, names)

    def one(group: pa.Table) -> pa.Table:
        cuts, settings, _, _, at = shared.value
        fit, tree, node = (group.column(c)[0].as_py() for c in ("fit", "tree", "node"))
        whole = lambda c, kind: np.concatenate([np.frombuffer(v.as_buffer(), kind) for v in group.column(c)])
        stats = [whole("label", kind), whole("weight", np.int32).astype(np.int64), whole("rows", np.int32).astype(np.int64)]
        path, depth = at[fit, tree, node]
        made = grow(whole("bins", np.uint8).reshape(-1, width), stats, cuts, settings[fit], path, depth, unit)
        return pa.table({"fit": pa.array([fit], pa.int32()), "tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int32()),
                         **{c: pa.array([a.tobytes()], pa.binary()) for c, a in zip("abcd", made)}})

    dealt = rows.select("id", "label", "train", "bins").mapInArrow(
        deal, "fit int, tree int, node int, label binary, weight binary, rows binary, bins binary")
    # A given number of partitions keeps small inputs of long work apart.
    n = min(len(nodes), max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))
    path = fresh_path(spark, "subtrees")
    dealt.repartition(n, "fit", "tree", "node").groupBy("fit", "tree", "node").applyInArrow(one, PARTS).write.parquet(path)
    shared.destroy()
    return path


def _records(held: Sequence[tuple], names: Sequence[str]) -> pa.RecordBatch:
    """Numbers first, then blocks of bytes, as the columns ``names``."""
    return pa.record_batch([pa.array(c, pa.int32() if isinstance(c[0], int) else pa.binary()) for c in zip(*held)], list(names))


def _clustered(rows: DataFrame) -> DataFrame:
    """Written rows anew, those that are binned alike side by side, so that tasks meet them together.

    Ranges end within a large group of them, so that no task gets more rows than others.
    """
    count, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    n = max(min(MOST_FILES, count // CHUNK), min(cores, count // LEAST_FILE))
    if n > 1:
        rows = rows.repartitionByRange(n, "bins", "train", "id")
    else:
        rows = rows.coalesce(1)
    return materialize(rows.sortWithinPartitions("bins", "train", "id"), "clustered")


def _in_units(rows: DataFrame, middle: float, far: float, n: int) -> tuple[DataFrame, float]:
    """Labels from the middle on as whole numbers of a unit so small that sums of all draws just fit.

    Sums are exact then, and no split depends on how rows lie in tasks. Labels that are no numbers stay as they are.
    """
    label = F.col("label") - F.lit(middle)
    if not math.isfinite(far):
        return rows.withColumn("label", label), 1.0
    bits = min(1000, 62 - math.ceil(math.log2(len(POISSON) * n) + math.log2(far))) if far else 0
    return rows.withColumn("label", F.rint(label * F.lit(2.0 ** bits)).cast("long")), 2.0 ** -bits


@dataclass(frozen=True)
class Table:
    """Binned rows that forests are grown from, written once for any settings."""

    rows: DataFrame  # id, label, train (a bit for each part) and bins
    bins: Bins
    sizes: list[int]  # training rows of each part
    different: int  # binned rows, the most that a tree's task can get
    middle: float
    unit: float


def prepare(df: DataFrame, trains: Sequence[Column], key: Sequence[str], n_features: int, features: str = "features",
            label: str = "t", max_bins: int = MAX_BINS) -> Table:
    """The rows of all ``trains``, binned; a part without rows is an error."""
    if not 0 < len(trains) <= MAX_FITS:
        raise ValueError(f"between 1 and {MAX_FITS} fits share a table")
    if n_features < 1:
        raise ValueError("a fit needs a feature")
    bits = sum((F.when(train, F.lit(1 << i)).otherwise(F.lit(0)) for i, train in enumerate(trains)), F.lit(0)).cast("long")
    used = df.select(F.xxhash64(*key).alias("id"), F.col(label).cast("double").alias("label"), features, bits.alias("train")).filter("train != 0")
    bins = quantile_cuts(used, n_features, features, max_bins)
    rows = _clustered(materialize(binned(used, bins, ["id", "label", "train"], features), "binned"))
    own = [F.col("train").bitwiseAND(F.lit(1 << i)) != 0 for i in range(len(trains))]
    count = rows.agg(F.avg("label").alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi"),
                     *[F.sum(c.cast("long")).alias(f"n{i}") for i, c in enumerate(own)]).collect()[0]
    sizes = [count[f"n{i}"] or 0 for i in range(len(trains))]
    if not min(sizes):
        raise ValueError("a forest has no rows to learn from")
    middle = float(count.m)  # labels count from here, so that sums stay exact where labels are far from 0
    different = rows.select("bins").distinct().count()
    rows, unit = _in_units(rows, middle, max(middle - count.lo, count.hi - middle), max(sizes))
    return Table(rows, bins, sizes, different, middle, unit)


def fit_many(df: DataFrame, fits: Sequence[Fit], key: Sequence[str], n_features: int, seed: int = 73, features: str = "features",
             label: str = "t", max_bins: int = MAX_BINS, local_rows: int = LOCAL_ROWS) -> list[Forest]:
    """Fit all forests at once. A fit without rows is an error; a tree that drew no row predicts the average label."""
    return fit_table(prepare(df, [f.train for f in fits], key, n_features, features, label, max_bins), fits, seed, local_rows)


def fit_table(table: Table, fits: Sequence[Fit], seed: int = 73, local_rows: int = LOCAL_ROWS) -> list[Forest]:
    """A forest for each part of a prepared table, in the order of the parts."""
    rows, bins, sizes, different, middle, unit = table.rows, table.bins, table.sizes, table.different, table.middle, table.unit
    n_features = len(bins.cuts)
    local = min(local_rows, LOCAL_BYTES // (n_features + 32))
    tops = {(i, t): _Growing(root_path(seed, t)) for i, f in enumerate(fits) for t in range(f.settings.n_estimators)}
    small = [(*k, 0) for k in tops if min(sizes[k[0]], different) <= local]
    large = [(*k, 0) for k in tops if min(sizes[k[0]], different) > local]
    total = int(bins.offsets[-1])
    per_pass = max(1, NUMBERS // (4 * (total + 1)))
    while large:
        now, large = large[:per_pass], large[per_pass:]
        sums = _level_pass(rows, bins, {k: tops[k].packed() for k in {n[:2] for n in now}}, now, seed, unit)
        cells, totals = sums[:, :-1].reshape(-1, 4), sums[:, -1]
        at = np.flatnonzero(cells[:, 2])
        rules = [fits[i].settings for i, _, _ in now]
        may = np.array([bool(s.open(n, tops[k[:2]].depth[k[2]])) for s, n, k in zip(rules, totals[:, 2], now)])
        best = choose(at // total, at % total, list(cells[at].T), list(totals.T), bins, np.concatenate([tops[i, t].path[n] for i, t, n in now]),
                      np.array([s.min_samples_leaf for s in rules]), np.array([s.drawn(n_features) for s in rules]))
        left = np.stack(best.left, axis=1)
        for j, (i, t, node) in enumerate(now):
            tree = tops[i, t]
            tree.value[node] = totals[j, 0] / totals[j, 1] if totals[j, 1] else 0.0
            if best.feature[j] < 0 or not may[j]:
                continue
            parts = (left[j], totals[j] - left[j])
            for child, part in zip(tree.split(node, int(best.feature[j]), int(best.bin[j]), parts), parts):
                if fits[i].settings.open(part[2], tree.depth[child]):
                    (small if part[3] <= local else large).append((i, t, child))
        large.sort()
    pairs = sorted({n[:2] for n in small}, key=lambda k: k[::-1])  # fits that share a tree go into the same job
    at_once = max(TREES_AT_ONCE, JOB_BYTES // (min(max(sizes), different) * (n_features + 16)))
    paths = []
    for first in range(0, len(pairs), at_once):
        some = set(pairs[first:first + at_once])
        paths.append(_finish(rows, bins, fits, tops, [n for n in small if n[:2] in some], seed, unit))
    parts = rows.sparkSession.read.schema(PARTS).parquet(*paths) if paths else None
    below = {} if parts is None else {r.fit: r.n for r in parts.groupBy("fit").agg(F.sum(F.octet_length("d") / 8).cast("long").alias("n")).collect()}
    out = []
    for i, f in enumerate(fits):
        own_tops = [tops[i, t].packed() for t in range(f.settings.n_estimators)]
        own_parts = None if i not in below else parts.filter(F.col("fit") == i).drop("fit")
        out.append(Forest(bins, own_tops, (*f.scale, middle), own_parts, below.get(i, 0) + sum(len(t[0]) for t in own_tops)))
    return out
