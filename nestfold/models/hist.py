"""Trees from histograms: quantile bins, sums per (node, feature, bin), and the best split of each node.

Features are cut once at quantiles of a mergeable sketch and kept as one byte
each. A level of a tree is one pass: every task adds up its rows per node and
bin, and only the sums come together. Their size follows from nodes and bins,
not from rows; when a level has too many nodes for one pass, it takes several.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from nestfold.models.passes import matrix, sum_over_rows
from nestfold.session import ship_package

MAX_BINS = 256
SMALLEST_GAIN = 1e-6  # fixed value: splits that gain no more are rounding noise
MAX_LEAVES = 1 << 20  # of one tree; it is held by the driver


@dataclass(frozen=True)
class Bins:
    """Cut points of each feature: bin b holds values over cut b - 1 up to cut b; NaN lies in the last."""

    cuts: tuple[np.ndarray, ...]

    @property
    def sizes(self) -> np.ndarray:
        return np.array([len(c) + 1 for c in self.cuts], np.int64)

    @property
    def offsets(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.sizes)])

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(self.cuts)], axis=1).astype(np.uint8)


def quantile_cuts(df: DataFrame, n_features: int, features: str = "features", bins: int = MAX_BINS) -> Bins:
    """Cuts at quantiles of all rows, from one pass; the sketch's rank error is a tenth of a bin."""
    if not 2 <= bins <= MAX_BINS:
        raise ValueError(f"{bins} bins do not fit into a byte")
    shares = F.lit([i / bins for i in range(1, bins)])
    sketch = lambda i: F.percentile_approx(F.col(features)[i].cast("double"), shares, 10 * bins)
    row = df.agg(*[F.struct(sketch(i).alias("cuts"), F.max(F.col(features)[i].cast("double")).alias("most")).alias(f"f{i}")
                   for i in range(n_features)]).collect()[0]
    found = []
    for one in row:
        cuts = np.unique([c for c in one.cuts or [] if not np.isnan(c)])
        found.append(cuts[cuts < one.most] if len(cuts) else cuts)
    return Bins(tuple(found))


def binned(df: DataFrame, bins: Bins, keep: Sequence[str], features: str = "features") -> DataFrame:
    """``keep`` and a column ``bins`` with one byte for each feature."""
    import pyarrow as pa

    ship_package(df.sparkSession)

    def task(stream):
        for batch in stream:
            if batch.num_rows:
                made = bins.of(matrix(batch.column(features)))
                width = made.shape[1]
                at = pa.py_buffer(np.arange(0, (len(made) + 1) * width, width, dtype=np.int32) if width else np.zeros(len(made) + 1, np.int32))
                column = pa.Array.from_buffers(pa.binary(), len(made), [None, at, pa.py_buffer(made.tobytes())])
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], column], [*keep, "bins"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    return df.select(*keep, features).mapInArrow(task, f"{types}, bins binary")


def bins_of(column, n_features: int) -> np.ndarray:
    """A column of packed bins as a matrix."""
    if not len(column) or not n_features:
        return np.zeros((len(column), n_features), np.uint8)
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0]:at[-1]].reshape(len(column), n_features)


@dataclass
class Tree:
    """A binary tree that grows: per node its feature (-1: a leaf), bin, children, value and depth."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    depth: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, bin_: int) -> tuple[int, int]:
        """Children of ``node``: up to the bin on the left, the rest on the right."""
        first = len(self.feature)
        if first > 2 * MAX_LEAVES:
            raise ValueError(f"a tree has more than {MAX_LEAVES} leaves: raise min_child_weight or lower max_depth")
        self.feature[node], self.bin[node], self.left[node] = feature, bin_, first
        for _ in range(2):
            self.feature.append(-1), self.bin.append(0), self.left.append(0), self.value.append(0.0)
            self.depth.append(self.depth[node] + 1)
        return first, first + 1

    def packed(self) -> tuple[np.ndarray, ...]:
        return (np.array(self.feature, np.int32), np.array(self.bin, np.int32), np.array(self.left, np.int32), np.array(self.value))


def nodes_of(tree: tuple[np.ndarray, ...], binned_rows: np.ndarray) -> np.ndarray:
    """The node that each row has reached."""
    feature, cut, left, _ = tree
    node = np.zeros(len(binned_rows), np.int32)
    if feature[0] < 0:
        return node
    flat, width = binned_rows.ravel(), binned_rows.shape[1]
    open_, at = np.arange(len(binned_rows)), node
    while len(open_):
        at = left[at] + (flat[open_ * width + feature[at]] > cut[at])
        node[open_] = at
        more = feature[at] >= 0
        open_, at = open_[more], at[more]
    return node


def histogram(binned_rows: np.ndarray, offsets: np.ndarray, node: np.ndarray, n_nodes: int, stats: Sequence[np.ndarray | None]) -> np.ndarray:
    """Sums per (node, bin, statistic); a statistic of None counts rows."""
    total = int(offsets[-1])
    at = (node[:, None] * total + (offsets[:-1] + binned_rows)).ravel()
    width = binned_rows.shape[1]
    return np.stack([
        np.bincount(at, None if s is None else np.repeat(s, width), n_nodes * total) for s in stats], axis=1
    ).reshape(n_nodes, total, len(stats))


def above(rows: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries above the first bin: their rows and their places among all bins."""
    flat = rows.ravel()
    at = np.flatnonzero(flat)
    row, feature = np.divmod(at, rows.shape[1])
    return row, offsets[feature] + flat[at]


def gradient_sums(entries: tuple[np.ndarray, np.ndarray], offsets: np.ndarray, node: np.ndarray, n_nodes: int, gradient: np.ndarray) -> np.ndarray:
    """(node, bin, (gradient, rows)) of entries above the first bins; the last bin holds the node's totals.

    ``node`` and ``gradient`` are those of all rows; a node of -1 takes no part.
    """
    total = int(offsets[-1]) + 1
    row, place = entries
    at = node[row]
    use = at >= 0
    used = np.flatnonzero(node >= 0)
    key = np.concatenate([at[use] * total + place[use], node[used] * total + total - 1])
    stats = np.concatenate([gradient[row[use]], gradient[used]])
    return np.stack([np.bincount(key, stats, n_nodes * total), np.bincount(key, minlength=n_nodes * total)], axis=1).reshape(n_nodes, total, 2)


def with_first_bins(sums: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(node, bin, statistic) of all bins from those above the first ones and the totals."""
    out, totals = sums[:, :-1].copy(), sums[:, -1]
    out[:, offsets[:-1]] = totals[:, None] - np.add.reduceat(out, offsets[:-1], axis=1)
    return out


def root_sums(df: DataFrame, bins: Bins, features: str = "features", label: str = "y") -> np.ndarray:
    """(bin, (g, h)) of a first tree's root over all rows, the predictions being 0."""
    offsets = bins.offsets

    def task(stream):
        total = np.zeros((1, int(offsets[-1]), 2))
        for batch in stream:
            if batch.num_rows:
                rows = bins_of(batch.column("bins"), len(bins.cuts))
                total += histogram(rows, offsets, np.zeros(len(rows), np.int64), 1, [-batch.column(label).to_numpy(zero_copy_only=False), None])
        return total.ravel()

    return sum_over_rows(binned(df, bins, [label], features), [label, "bins"], task, 2 * int(offsets[-1])).reshape(-1, 2)


def shrunk(g: np.ndarray, alpha: float) -> np.ndarray:
    """The gradient sum moved towards zero by the absolute penalty."""
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0)


def score(g: np.ndarray, h: np.ndarray, alpha: float, lambda_: float) -> np.ndarray:
    """Twice what the best value of a node takes off the loss; 0 for a node without curvature."""
    weight = h + lambda_
    return np.divide(shrunk(g, alpha) ** 2, weight, out=np.zeros_like(weight, dtype=float), where=weight > 0)


def leaf_value(g: float, h: float, alpha: float, lambda_: float) -> float:
    return float(-shrunk(np.array(g), alpha) / (h + lambda_)) if h + lambda_ > 0 else 0.0


def best_splits(
    sums: np.ndarray, bins: Bins, allowed: np.ndarray, alpha: float, lambda_: float, min_weight: float,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node of ``sums`` (nodes, bins, (g, h)): gain, feature and bin of its best split.

    Both sides must have a curvature of ``min_weight``. Equal gains go to the
    first feature, then the first bin; a node without a split gains -inf.
    """
    offsets = bins.offsets
    feature = np.repeat(np.arange(len(bins.cuts)), bins.sizes)
    running = np.cumsum(sums, axis=1)
    before = np.concatenate([np.zeros_like(running[:, :1]), running], axis=1)[:, offsets[:-1]][:, feature]
    left = running - before
    total = left[:, offsets[1] - 1][:, None]
    right = total - left
    gain = (score(left[..., 0], left[..., 1], alpha, lambda_) + score(right[..., 0], right[..., 1], alpha, lambda_)
            - score(total[..., 0], total[..., 1], alpha, lambda_))
    usable = allowed[feature] & (np.arange(len(feature)) != offsets[1:][feature] - 1)
    ok = usable & (left[..., 1] >= max(min_weight, SMALLEST_GAIN)) & (right[..., 1] >= max(min_weight, SMALLEST_GAIN))
    gain = np.where(ok, gain, -np.inf)
    best = gain.argmax(axis=1)
    return gain[np.arange(len(gain)), best], feature[best], best - offsets[feature[best]]
