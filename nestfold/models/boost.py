"""Regularised gradient boosting for squared error, many fits in the same passes.

A round grows one tree for every fit, level by level from histograms. All fits
of a search share the binned table: a row belongs to some fits' training rows
and to others' validation rows, by bits of two columns. Fits of a group (the
inner folds of one configuration) take their rounds in lockstep and stop
together, when their average validation error has not fallen for ``patience`` rounds;
they keep the trees up to their best round.

The settings mean what they mean in the library whose names they bear: a gain is twice the
loss reduction and must reach ``gamma``; ``reg_alpha`` and ``reg_lambda`` shrink
leaf values and gains; ``min_child_weight`` is a sum of curvatures, which for
squared error is a number of rows; ``colsample_bytree`` draws columns once for a tree and
``subsample`` rows, by a hash of the row's key, so that a lost task draws the same again.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from nestfold.models.hist import (
    MAX_BINS, SMALLEST_GAIN, Bins, Tree, above, best_splits, binned, bins_of, gradient_sums, leaf_value, nodes_of, quantile_cuts, with_first_bins,
)
from nestfold.models.passes import append_columns, sum_over_rows
from nestfold.sources.storage import materialize

STORE_EVERY = 4  # rounds after which the fits' predictions are written beside the rows; each pass routes rows through all trees since
NUMBERS = 4_000_000  # in the histograms of one pass
MAX_FITS = 62  # bits of a column


@dataclass(frozen=True)
class Settings:
    learning_rate: float = 0.1
    max_depth: int = 6
    reg_alpha: float = 0.0
    reg_lambda: float = 1.0
    gamma: float = 0.0
    min_child_weight: float = 1.0
    subsample: float = 1.0
    colsample_bytree: float = 1.0

    def __post_init__(self):
        for name in ("learning_rate", "subsample", "colsample_bytree"):
            if not 0 < getattr(self, name) <= 1:
                raise ValueError(f"{name} must lie in (0, 1]")
        for name in ("max_depth", "reg_alpha", "reg_lambda", "gamma", "min_child_weight"):
            if not getattr(self, name) >= 0:
                raise ValueError(f"{name} must not be negative")

    @classmethod
    def of(cls, params: Mapping[str, Any]) -> Settings:
        return cls(**{n: cls.__dataclass_fields__[n].type == "int" and int(params[n]) or float(params[n])
                      for n in cls.__dataclass_fields__ if params.get(n) is not None})


@dataclass(frozen=True)
class Fit:
    """One model to fit: its settings, and conditions for its training and validation rows.

    It is fitted to ``scale[0] * label + scale[1]``, as runs scale the label by their own training rows.
    """

    settings: Settings
    train: Column
    valid: Column | None = None
    group: int = 0
    rounds: int = 100
    scale: tuple[float, float] = (1.0, 0.0)


@dataclass
class Boosted:
    """A fitted model: a start value and trees over binned features."""

    bins: Bins
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    errors: list[float] = field(default_factory=list)  # validation RMSE after each round

    def predict_arrays(self, x: np.ndarray) -> np.ndarray:
        return _margin(self.base, [t.packed() for t in self.trees], self.bins.of(x))

    def predict(self, df: DataFrame, keep: Sequence[str], features: str = "features") -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast((self.bins, self.base, [t.packed() for t in self.trees]))

        def compute(x: np.ndarray) -> dict[str, np.ndarray]:
            bins, base, trees = shared.value
            return {"pred_mean": _margin(base, trees, bins.of(x))}

        return append_columns(df, features, keep, compute, "pred_mean double")


def _margin(base, trees, rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows)) + base
    for tree in trees:
        out += tree[3][nodes_of(tree, rows)]
    return out


def uniform(ids: np.ndarray, seed: int, round_: int) -> np.ndarray:
    """A number in [0, 1) for each row id and round."""
    key = np.uint64((seed * 0x9E3779B97F4A7C15 + round_ * 0xC2B2AE3D27D4EB4F) & (1 << 64) - 1)
    h = ids.astype(np.int64).view(np.uint64) ^ key
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)) * 2.0 ** -53


def sampled_columns(settings: Settings, n_features: int, seed: int, round_: int) -> np.ndarray:
    """Which columns a round's tree may use."""
    n = max(1, int(settings.colsample_bytree * n_features))
    out = np.zeros(n_features, bool)
    out[np.random.default_rng((seed, round_)).permutation(n_features)[:n]] = True
    return out


class _Table:
    """The binned rows, and for every fit the predictions of the rounds stored so far."""

    def __init__(self, df: DataFrame, fits: Sequence[Fit], key: Sequence[str], features: str, label: str, n_features: int, max_bins: int):
        bits = lambda conditions: sum(
            (F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(conditions) if c is not None), F.lit(0)).cast("long")
        used = df.select(
            F.xxhash64(*key).alias("id"), F.col(label).cast("double").alias("label"), features,
            bits([f.train for f in fits]).alias("train"), bits([f.valid for f in fits]).alias("valid"))
        self.bins = quantile_cuts(used.filter("train != 0"), n_features, features, max_bins)
        self.n_features, self.n_fits = n_features, len(fits)
        rows = binned(used.filter("train != 0 or valid != 0"), self.bins, ["id", "label", "train", "valid"], features)
        self.rows = materialize(rows.withColumn("stored", F.lit(None).cast("array<double>")), "binned")
        self.fresh: list[list] = [[] for _ in fits]  # packed trees since the last store
        sums = self.rows.agg(*[F.avg(F.when(F.col("train").bitwiseAND(F.lit(1 << i)) != 0, F.col("label"))) for i in range(len(fits))])
        self.scales = [f.scale for f in fits]
        self.base = [a * v + b if v is not None else 0.0 for v, (a, b) in zip(sums.collect()[0], self.scales)]
        self.has_stored = False

    def state(self) -> tuple:
        return self.n_features, None if self.has_stored else self.base, self.fresh

    def store(self) -> None:
        """Write the predictions beside the rows, so that later passes need only newer trees."""
        state, n_fits = self.state(), self.n_fits

        def task(stream):
            import pyarrow as pa

            for batch in stream:
                if batch.num_rows:
                    rows, margins = _rows(batch, state, n_fits, range(n_fits))
                    flat = np.stack([margins[i] for i in range(n_fits)], axis=1).ravel()
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, n_fits), pa.int32()), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([*batch.columns[:4], batch.column("bins"), lists], ["id", "label", "train", "valid", "bins", "stored"])

        self.rows = materialize(self.rows.select("id", "label", "train", "valid", "bins", "stored").mapInArrow(
            task, "id long, label double, train long, valid long, bins binary, stored array<double>"), "binned")
        self.fresh, self.has_stored = [[] for _ in range(n_fits)], True


def _rows(batch, state: tuple, n_fits: int, wanted: Sequence[int]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Bins of a batch, and the predictions of the wanted fits."""
    n_features, base, fresh = state
    rows = bins_of(batch.column("bins"), n_features)
    stored = None if base is not None else batch.column("stored").flatten().to_numpy().reshape(len(rows), n_fits)
    return rows, {i: _margin(base[i] if base is not None else stored[:, i], fresh[i], rows) for i in wanted}


def _level_pass(table: _Table, fits: Sequence[Fit], growing: Mapping[int, Tree], nodes: Sequence[tuple[int, int]], seed: int,
                round_: int, judged: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Histograms (node, bin, (g, h)) of ``nodes`` (fit, node), and (squared error, rows) on the validation rows of ``judged`` fits."""
    offsets, total = table.bins.offsets, int(table.bins.offsets[-1])
    size = len(nodes) * (total + 1) * 2
    places = {}
    for at, (fit, node) in enumerate(nodes):
        places.setdefault(fit, {})[node] = at
    shared = table.rows.sparkSession.sparkContext.broadcast((
        table.state(), table.n_fits, {i: growing[i].packed() for i in places}, places, {i: fits[i].settings.subsample for i in places}, table.scales))

    def task(stream):
        state, n_fits, trees, where, share, scales = shared.value
        out, errors = np.zeros((len(nodes), total + 1, 2)), np.zeros((len(judged), 2))
        for batch in stream:
            if not batch.num_rows:
                continue
            rows, margins = _rows(batch, state, n_fits, sorted({*where, *judged}))
            label, ids = batch.column("label").to_numpy(), batch.column("id").to_numpy()
            train, valid = batch.column("train").to_numpy(), batch.column("valid").to_numpy()
            drawn = uniform(ids, seed, round_)
            entries = above(rows, offsets) if where else None
            for fit, own in where.items():
                use = np.flatnonzero((train >> fit & 1).astype(bool) & (drawn < share[fit]))
                place = np.full(len(trees[fit][0]), -1)
                place[list(own)] = list(own.values())
                first = min(own.values())
                node = np.full(len(rows), -1)
                reached = place[nodes_of(trees[fit], rows[use])]
                node[use] = np.where(reached >= 0, reached - first, -1)
                a, b = scales[fit]
                out[first:first + len(own)] += gradient_sums(entries, offsets, node, len(own), margins[fit] - (a * label + b))
            for at, fit in enumerate(judged):
                use = (valid >> fit & 1).astype(bool)
                a, b = scales[fit]
                errors[at] += ((margins[fit][use] - (a * label[use] + b)) ** 2).sum(), use.sum()
        return np.concatenate([out.ravel(), errors.ravel()])

    summed = sum_over_rows(table.rows, ["id", "label", "train", "valid", "bins", "stored"], task, size + 2 * len(judged), shared)
    return with_first_bins(summed[:size].reshape(len(nodes), total + 1, 2), offsets), summed[size:].reshape(len(judged), 2)


def fit_many(
    df: DataFrame, fits: Sequence[Fit], key: Sequence[str], n_features: int, patience: int | None = None, seed: int = 42,
    features: str = "features", label: str = "t", max_bins: int = MAX_BINS,
) -> list[Boosted]:
    """Fit all models at once; see the module's text for lockstep stopping."""
    if not 0 < len(fits) <= MAX_FITS:
        raise ValueError(f"between 1 and {MAX_FITS} fits share a table")
    if n_features < 1 or min(f.rounds for f in fits) < 1:
        raise ValueError("a fit needs a feature and a round")
    table = _Table(df, fits, key, features, label, n_features, max_bins)
    models = [Boosted(table.bins, base) for base in table.base]
    active = list(range(len(fits)))
    best: dict[int, tuple[float, int]] = {}
    per_pass = max(1, NUMBERS // (2 * (int(table.bins.offsets[-1]) + 1)))
    round_ = 0
    while active:
        active_now = [i for i in active if len(models[i].trees) < fits[i].rounds]
        trees = {i: Tree() for i in active_now}
        columns = {i: sampled_columns(fits[i].settings, n_features, seed, round_) for i in trees}
        judged = [i for i in active if fits[i].valid is not None and models[i].trees]
        todo = [(i, 0) for i in trees]
        first = True
        while todo or (first and judged):
            some, todo = todo[:per_pass], todo[per_pass:]
            sums, errors = _level_pass(table, fits, trees, some, seed, round_, judged if first else [])
            if first:
                for i, (squares, n) in zip(judged, errors):
                    models[i].errors.append(float(np.sqrt(squares / n)) if n else float("nan"))
                stopped = _stopped(fits, models, judged, best, patience)
                active = [i for i in active_now if i not in stopped]
                keep = [j for j, (i, _) in enumerate(some) if i in active]
                sums, some = sums[keep], [some[j] for j in keep]
                todo = [(i, n) for i, n in todo if i in active]
            for (i, node), own in zip(some, sums):
                todo += [(i, child) for child in _grow(trees[i], node, own[None], table.bins, columns[i], fits[i].settings)]
            # Nodes of one fit stand together, as the pass adds them as one block.
            todo.sort()
            first = False
        for i in active:
            tree = trees[i]
            tree.value = [v * fits[i].settings.learning_rate for v in tree.value]
            models[i].trees.append(tree)
            table.fresh[i].append(tree.packed())
        round_ += 1
        active = [i for i in active if len(models[i].trees) < fits[i].rounds or fits[i].valid is not None]
        if active and round_ % STORE_EVERY == 0:
            table.store()
    for i, model in enumerate(models):
        if fits[i].group in best and fits[i].valid is not None:
            model.trees = model.trees[:best[fits[i].group][1]]
    return models


def _stopped(fits, models, judged, best, patience) -> set[int]:
    """Fits whose group has not improved for ``patience`` rounds; updates the groups' best (error, round)."""
    out = set()
    for group in {fits[i].group for i in judged}:
        members = [i for i in judged if fits[i].group == group]
        error, round_ = float(np.mean([models[i].errors[-1] for i in members])), len(models[members[0]].trees)
        if np.isnan(error):
            out |= set(members)
        elif group not in best or error < best[group][0]:
            best[group] = error, round_
        elif patience is not None and round_ - best[group][1] >= patience:
            out |= set(members)
    return out


def _grow(tree: Tree, node: int, sums: np.ndarray, bins: Bins, columns: np.ndarray, s: Settings) -> list[int]:
    """Split a node by its histogram or make it a leaf; returns the children that may be split again.

    Children that may not are leaves, with the sums that the split left them: no pass is needed for these.
    """
    n = int(bins.sizes[0])
    g, h = sums[0, :n].sum(axis=0)
    if _may_split(tree.depth[node], h, s):
        gain, feature, cut = best_splits(sums, bins, columns, s.reg_alpha, s.reg_lambda, s.min_child_weight)
        if gain[0] > SMALLEST_GAIN and gain[0] >= s.gamma:
            first = bins.offsets[feature[0]]
            left = sums[0, first:first + cut[0] + 1].sum(axis=0)
            children = tree.split(node, int(feature[0]), int(cut[0]))
            open_ = []
            for child, (g_, h_) in zip(children, (left, (g, h) - left)):
                tree.value[child] = leaf_value(g_, h_, s.reg_alpha, s.reg_lambda)
                if _may_split(tree.depth[child], h_, s):
                    open_.append(child)
            return open_
    tree.value[node] = leaf_value(g, h, s.reg_alpha, s.reg_lambda)
    return []


def _may_split(depth: int, h: float, s: Settings) -> bool:
    return depth < s.max_depth and h >= 2 * s.min_child_weight
