"""Boosting against a plain version, tree by tree, and its stopping rule."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nestfold.models import boost, hist, passes
from nestfold.sources.storage import materialize


@pytest.fixture(scope="module")
def table(spark):
    """500 rows, five features (one constant, one of three values), a fold, and a target of three of them."""
    df = spark.range(500).select(
        "id", ((F.col("id") * 37 % 500) / 500).alias("a"), ((F.col("id") * 61 % 500) / 250).alias("b"),
        (F.col("id") % 3).cast("double").alias("c"), F.lit(1.0).alias("d"), F.sin(F.col("id").cast("double")).alias("e"))
    y = F.sin(6 * F.col("a")) + 0.4 * F.col("b") * F.col("c") + 0.2 * F.col("e")
    return materialize(df.select("id", F.array("a", "b", "c", "d", "e").alias("features"), y.alias("t"), (F.col("id") % 4 + 1).alias("fold")).repartition(5), "boost")


@pytest.fixture(scope="module")
def arrays(table):
    rows = table.withColumn("hash", F.xxhash64("id")).orderBy("id").collect()
    return (np.array([r.features for r in rows]), np.array([r.t for r in rows]), np.array([r.hash for r in rows]), np.array([r.fold for r in rows]))


def plain_fit(binned, sizes, y, ids, s, rounds, seed):
    """Boosting written out row set by row set; trees as nested tuples, and the training predictions."""
    shrink = lambda g: np.sign(g) * max(abs(g) - s.reg_alpha, 0)
    gain_of = lambda r: shrink((pred[r] - y[r]).sum()) ** 2 / (len(r) + s.reg_lambda)
    pred, trees = np.full(len(y), y.mean()), []
    for round_ in range(rounds):
        columns = boost.sampled_columns(s, binned.shape[1], seed, round_)
        drawn = np.flatnonzero(boost.uniform(ids, seed, round_) < s.subsample)

        def grow(rows, depth):
            best = (max(1e-6, s.gamma), None)
            for f in np.flatnonzero(columns) if depth < s.max_depth else ():
                for cut in range(sizes[f] - 1):
                    left, right = rows[binned[rows, f] <= cut], rows[binned[rows, f] > cut]
                    if min(len(left), len(right)) >= max(s.min_child_weight, 1):
                        gain = gain_of(left) + gain_of(right) - gain_of(rows)
                        if gain > best[0] + 1e-9:
                            best = gain, (f, cut, left, right)
            if best[1] is None:
                return -s.learning_rate * shrink((pred[rows] - y[rows]).sum()) / (len(rows) + s.reg_lambda)
            f, cut, left, right = best[1]
            return int(f), cut, grow(left, depth + 1), grow(right, depth + 1)

        def value(tree, row):
            while isinstance(tree, tuple):
                tree = tree[2] if binned[row, tree[0]] <= tree[1] else tree[3]
            return tree

        tree = grow(drawn, 0)
        trees.append(tree)
        pred = pred + [value(tree, row) for row in range(len(y))]
    return trees, pred


def nested_tuples(tree, node=0):
    if tree.feature[node] < 0:
        return tree.value[node]
    left = tree.left[node]
    return tree.feature[node], tree.bin[node], nested_tuples(tree, left), nested_tuples(tree, left + 1)


def same(a, b):
    if isinstance(a, tuple) and isinstance(b, tuple):
        return a[:2] == b[:2] and same(a[2], b[2]) and same(a[3], b[3])
    return not isinstance(a, tuple) and not isinstance(b, tuple) and a == pytest.approx(b, rel=1e-9, abs=1e-12)


SETTINGS = [
    boost.Settings(learning_rate=0.3, max_depth=4, reg_alpha=0.5, reg_lambda=2.0, gamma=0.05, min_child_weight=5),
    boost.Settings(learning_rate=0.2, max_depth=60, reg_alpha=0.0, reg_lambda=1e-8, gamma=1e-3, min_child_weight=2.5, subsample=0.6, colsample_bytree=0.5),
    boost.Settings(learning_rate=0.5, max_depth=3, reg_alpha=40.0, reg_lambda=0.0, gamma=0.0, min_child_weight=200),
]


@pytest.mark.parametrize("s", SETTINGS)
def test_equals_the_plain_version(table, arrays, s, monkeypatch):
    x, y, ids, _ = arrays
    fit = boost.Fit(s, F.lit(True), rounds=4)
    model = boost.fit_many(table, [fit], ["id"], 5, max_bins=16)[0]
    trees, pred = plain_fit(model.bins.of(x), model.bins.sizes, y, ids, s, 4, 42)
    assert [same(nested_tuples(a), b) for a, b in zip(model.trees, trees)] == [True] * 4
    assert np.allclose(model.predict_arrays(x), pred)
    got = {r.id: r.pred_mean for r in model.predict(table, ["id"]).collect()}
    assert np.allclose([got[i] for i in range(500)], pred)
    # The same trees when nodes take several passes, sums are shuffled and predictions are stored between.
    monkeypatch.setattr(boost, "NUMBERS", 400)
    monkeypatch.setattr(boost, "STORE_EVERY", 2)
    monkeypatch.setattr(passes, "DIRECT", 0)
    if s.max_depth <= 4:
        again = boost.fit_many(table, [fit], ["id"], 5, max_bins=16)[0]
        assert all(same(nested_tuples(a), nested_tuples(b)) for a, b in zip(again.trees, model.trees))


def test_many_fits_equal_single_fits_and_stop_in_lockstep(table, arrays):
    s = boost.Settings(learning_rate=0.6, max_depth=5, min_child_weight=1, reg_lambda=0.1)
    folds = [boost.Fit(s, F.col("fold") != f, F.col("fold") == f, group=0, rounds=200) for f in range(1, 5)]
    other = boost.Fit(boost.Settings(max_depth=2), F.lit(True), group=1, rounds=3)
    models = boost.fit_many(table, [*folds, other], ["id"], 5, patience=3, max_bins=16)
    x, y, _, fold = arrays
    average = np.mean([m.errors for m in models[:4]], axis=0)
    best = int(average.argmin()) + 1
    assert len(average) == best + 3 < 200 and all(len(m.trees) == best for m in models[:4])
    for f, m in enumerate(models[:4], 1):
        rest = fold == f
        assert m.errors[best - 1] == pytest.approx(np.sqrt(((m.predict_arrays(x[rest]) - y[rest]) ** 2).mean()))
    alone = boost.fit_many(table, [other], ["id"], 5, max_bins=16)[0]
    assert len(models[4].trees) == 3
    assert all(same(nested_tuples(a), nested_tuples(b)) for a, b in zip(alone.trees, models[4].trees))


def test_cuts_are_quantiles(table, arrays):
    bins = hist.quantile_cuts(table, 5, bins=16)
    assert [len(c) for c in bins.cuts][2:4] == [2, 0]
    counts = np.bincount(bins.of(arrays[0])[:, 0], minlength=16)
    assert len(counts) == 16 and counts.max() - counts.min() <= 8
    assert hist.quantile_cuts(table.limit(0), 5).sizes.tolist() == [1] * 5


def test_a_leafy_tree_is_refused(monkeypatch, table):
    monkeypatch.setattr(hist, "MAX_LEAVES", 4)
    with pytest.raises(ValueError, match="leaves"):
        boost.fit_many(table, [boost.Fit(boost.Settings(max_depth=20), F.lit(True), rounds=1)], ["id"], 5)


def test_sums_above_the_first_bins_give_the_whole_histogram():
    rng = np.random.default_rng(3)
    offsets = np.array([0, 9, 10, 12, 15])  # the second feature is constant
    rows = np.stack([rng.integers(0, n, 200) for n in np.diff(offsets)], axis=1).astype(np.uint8)
    node, gradient = rng.integers(-1, 3, 200), rng.normal(size=200)
    use = node >= 0
    whole = hist.histogram(rows[use], offsets, node[use], 3, [gradient[use], None])
    sparse = hist.gradient_sums(hist.above(rows, offsets), offsets, node, 3, gradient)
    assert np.allclose(hist.with_first_bins(sparse, offsets), whole) and sparse.shape == (3, 16, 2)


def test_leaves_of_the_last_level_take_no_pass(table, monkeypatch):
    passes_, real = [], boost._level_pass
    monkeypatch.setattr(boost, "_level_pass", lambda *a: passes_.append(a) or real(*a))
    model = boost.fit_many(table, [boost.Fit(boost.Settings(max_depth=2), F.lit(True), rounds=2)], ["id"], 5, max_bins=16)[0]
    assert len(passes_) == 4 and all(max(t.depth) == 2 for t in model.trees)
