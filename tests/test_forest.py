"""Forests: both ways of growing against a plain recursive version, and the settings as given."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from nestfold.models import forest, passes
from nestfold.plans import nested
from nestfold.sources.storage import materialize

N = 600


@pytest.fixture(scope="module")
def table(spark):
    """Two dense features, a constant, and one-hot columns; a target far from zero."""
    a, b = (F.col("id") * 37 % N) / N, (F.col("id") * 61 % N) / 250
    level = F.col("id") % 7
    hot = [(level == i).cast("double") for i in range(7)]
    y = 1000 + F.sin(6 * a) + 0.4 * b * (level % 3) + 0.01 * F.sin(F.col("id") * 13.7)
    return materialize(spark.range(N).select(
        "id", F.array(a, b, F.lit(1.0), *hot).alias("features"), y.alias("t"), (F.col("id") % 4 + 1).alias("fold")).repartition(5), "forest")


@pytest.fixture(scope="module")
def arrays(table):
    rows = table.withColumn("hash", F.xxhash64("id")).orderBy("id").collect()
    return np.array([r.features for r in rows]), np.array([r.t for r in rows]), np.array([r.hash for r in rows]), np.array([r.fold for r in rows])


def plain_tree(rows, sizes, y, ids, s, seed, tree, settings_of=None):
    """A tree written out row set by row set, as nested tuples."""
    w = forest.bootstrap(ids, seed, tree).astype(float)
    mean = y.mean()

    def score(r):
        return (w[r] * (y[r] - mean)).sum() ** 2 / w[r].sum()

    def grow(r, path, depth):
        leaf = float((w[r] * y[r]).sum() / w[r].sum())
        if len(r) < max(s.min_samples_split, 2 * s.min_samples_leaf) or depth >= s.max_depth:
            return leaf
        vary = [f for f in range(rows.shape[1]) if len(set(rows[r, f])) > 1]
        key = forest._mixed(path[0] ^ forest._mixed(np.array(vary, np.uint64))) if vary else []
        tried = sorted(f for _, f in sorted(zip(key, vary))[:s.drawn(rows.shape[1])])
        best, found = 1e-10 * score(r), None
        for f in tried:
            for cut in range(sizes[f] - 1):
                left, right = r[rows[r, f] <= cut], r[rows[r, f] > cut]
                if min(len(left), len(right)) >= s.min_samples_leaf:
                    gain = score(left) + score(right) - score(r)
                    if gain > best + 1e-9 * abs(best):
                        best, found = gain, (f, cut, left, right)
        if found is None:
            return leaf
        f, cut, left, right = found
        below = forest.child_paths(path)
        return f, cut, grow(left, below[:1], depth + 1), grow(right, below[1:], depth + 1)

    return grow(np.flatnonzero(w > 0), forest.root_path(seed, tree), 0)


def nested_tuples(tree, node=0):
    if tree[0][node] < 0:
        return tree[3][node]
    return tree[0][node], tree[1][node], nested_tuples(tree, tree[2][node]), nested_tuples(tree, tree[2][node] + 1)


def same(a, b):
    if isinstance(a, tuple) and isinstance(b, tuple):
        return a[:2] == b[:2] and same(a[2], b[2]) and same(a[3], b[3])
    return not isinstance(a, tuple) and not isinstance(b, tuple) and a == pytest.approx(b, rel=1e-9)


def depth_of(tree):
    return 1 + max(depth_of(tree[2]), depth_of(tree[3])) if isinstance(tree, tuple) else 0


SETTINGS = [
    forest.Settings(n_estimators=3, max_depth=100, min_samples_split=2, min_samples_leaf=1, max_features="sqrt"),
    forest.Settings(n_estimators=3, max_depth=5, min_samples_split=25, min_samples_leaf=4, max_features="auto"),
]


@pytest.mark.parametrize("s", SETTINGS)
@pytest.mark.parametrize("local", [10**6, 60, 12])
def test_equals_the_plain_version(table, arrays, s, local, monkeypatch):
    x, y, ids, _ = arrays
    monkeypatch.setattr(forest, "CHUNK", 50)
    if local == 12:  # nodes take several passes, their sums a shuffle, trees several jobs
        monkeypatch.setattr(forest, "NUMBERS", 4000)
        monkeypatch.setattr(forest, "TREES_AT_ONCE", 2)
        monkeypatch.setattr(passes, "DIRECT", 0)
    model = forest.fit_many(table, [forest.Fit(s, F.lit(True))], ["id"], x.shape[1], max_bins=32, local_rows=local)[0]
    rows = model.bins.of(x)
    plain = [plain_tree(rows, model.bins.sizes, y, ids, s, 73, t) for t in range(3)]
    assert [same(nested_tuples(a), b) for a, b in zip(model.trees, plain)] == [True] * 3
    got = {r.id: r.pred_mean for r in model.predict(table, ["id"]).collect()}
    assert np.allclose([got[i] for i in range(N)], model.predict_arrays(x))


def test_fits_share_passes_and_keep_their_rows(table, arrays):
    x, y, _, fold = arrays
    s = forest.Settings(n_estimators=4, min_samples_leaf=2)
    fits = [forest.Fit(s, F.col("fold") != f) for f in (1, 2)] + [forest.Fit(forest.Settings(n_estimators=1, max_depth=2), F.lit(True), (0.5, -500.0))]
    models = forest.fit_many(table, fits, ["id"], x.shape[1])
    for f, m in zip((1, 2), models):
        rest = fold == f
        assert ((m.predict_arrays(x[rest]) - y[rest]) ** 2).mean() < 0.2 * y.var()
    alone = forest.fit_many(table, [fits[0], fits[2]], ["id"], x.shape[1])[0]  # cut points are those of all rows
    assert all(same(nested_tuples(a), nested_tuples(b)) for a, b in zip(alone.trees, models[0].trees))
    assert len(models[2].trees) == 1 and depth_of(nested_tuples(models[2].trees[0])) == 2
    assert abs(models[2].predict_arrays(x).mean() - (0.5 * y.mean() - 500)) < 0.1


def test_depth_is_not_cut(spark):
    """A target that alternates is best split at an end, so the tree grows deeper than 30 levels."""
    df = spark.range(250).select("id", F.array(F.col("id").cast("double")).alias("features"), ((F.col("id") % 2) * 2.0 - 1).alias("t"))
    deep = forest.fit_many(df, [forest.Fit(forest.Settings(n_estimators=10, max_depth=100), F.lit(True))], ["id"], 1)[0]
    assert 30 < max(depth_of(nested_tuples(t)) for t in deep.trees) <= 100
    flat = forest.fit_many(df, [forest.Fit(forest.Settings(n_estimators=1, max_depth=3), F.lit(True))], ["id"], 1, local_rows=0)[0]
    assert depth_of(nested_tuples(flat.trees[0])) == 3


def test_odd_tables(spark, monkeypatch):
    one = spark.createDataFrame([(1, [2.0, 3.0], 5.0)], "id long, features array<double>, t double")
    model = forest.fit_many(one, [forest.Fit(forest.Settings(n_estimators=3), F.lit(True))], ["id"], 2)[0]
    assert np.allclose(model.predict_arrays(np.zeros((2, 2))), 5.0)
    with pytest.raises(ValueError, match="no rows"):
        forest.fit_many(one, [forest.Fit(forest.Settings(n_estimators=3), F.col("id") > 1)], ["id"], 2)
    with pytest.raises(ValueError, match="rule"):
        forest.Settings.of({"n_estimators": 1, "max_features": "half"})
    monkeypatch.setattr(forest, "MAX_LEAVES", 4)
    many = spark.range(300).select("id", F.array(F.col("id").cast("double")).alias("features"), F.col("id").cast("double").alias("t"))
    with pytest.raises(ValueError, match="leaves"):
        forest.fit_many(many, [forest.Fit(forest.Settings(n_estimators=1), F.lit(True))], ["id"], 1, local_rows=0)


def test_studies_run_the_settings_as_drawn(spark):
    df = spark.range(300).select("id", ((F.col("id") * 37 % 300) / 300).alias("a"), ((F.col("id") * 61 % 300) / 300).alias("b"))
    df = df.withColumn("y", F.sin(6 * F.col("a")) + F.col("b"))
    study = nested.prepare(df, ["id"], ["a", "b"], "curve", k_outer=3, k_inner=2)
    configs = [{"n_estimators": 8, "max_depth": 80, "min_samples_split": 3, "min_samples_leaf": 2, "max_features": "auto"}, {"n_estimators": 2, "max_depth": 0}]
    log = nested.search(study, "GRF", 1, configs, holdout_above=10**9).orderBy("number").collect()
    assert [r.message for r in log] == [None, None] and log[0].value < 0.1 * log[1].value
    rows, predictions = nested.evaluate(study, "GRF", {run: configs[0] for run in (1, 2, 3)})
    assert predictions.count() == 300 and all(r.mse < 0.05 for r in rows.collect())


@pytest.mark.parametrize("local", [10**6, 40])
def test_large_forests_predict_without_passing_through_the_driver(spark, table, arrays, local, monkeypatch):
    x, y, _, _ = arrays
    monkeypatch.setattr(forest, "SCORED_ROWS", 7)
    fits = [forest.Fit(forest.Settings(n_estimators=5, min_samples_leaf=2), F.col("fold") != 1, (0.5, -500.0)), forest.Fit(forest.Settings(n_estimators=2, max_depth=0), F.lit(True))]
    models = forest.fit_many(table, fits, ["id"], x.shape[1], local_rows=local)
    whole = [{r.id: r.pred_mean for r in m.predict(table, ["id"]).collect()} for m in models]
    monkeypatch.setattr(forest, "HELD_NODES", 0)
    monkeypatch.setattr(forest.Forest, "trees", property(lambda self: pytest.fail("the trees came to the driver")))
    twice = table.unionByName(table).withColumn("_at", F.lit(None).cast("string"))
    for m, known in zip(models, whole):
        got = m.predict(twice, ["id", "_at"]).collect()
        assert len(got) == 2 * N and all(r.pred_mean == known[r.id] and r["_at"] is None for r in got)
    assert models[0].predict(table.limit(0), ["id"]).count() == 0


def test_rows_that_are_binned_alike_count_as_one_for_a_task(spark, monkeypatch):
    """480 rows of 12 kinds, in an order that parts them: tasks finish the trees from 12 sums, and rows of a kind are predicted once."""
    df = spark.range(480).select("id", F.array(F.col("id") % 4 * 1.0, F.floor(F.col("id") / 160) * 1.0).alias("features"),
                                 ((F.col("id") * 37) % 101 + 10.0 * (F.col("id") % 4)).alias("t"), (F.col("id") % 3).alias("fold")).repartition(4)
    rows = df.withColumn("hash", F.xxhash64("id")).orderBy("id").collect()
    x, y, ids = np.array([r.features for r in rows]), np.array([r.t for r in rows]), np.array([r.hash for r in rows])
    monkeypatch.setattr(forest, "_level_pass", lambda *_: pytest.fail("a pass for nodes that a task can finish"))
    fits = [forest.Fit(SETTINGS[0], F.col("fold") != f) for f in (0, 1)]
    models = forest.fit_many(df, fits, ["id"], 2, local_rows=15)
    for f, model in zip((0, 1), models):
        mine = np.array([r.fold != f for r in rows])
        plain = [plain_tree(model.bins.of(x)[mine], model.bins.sizes, y[mine], ids[mine], SETTINGS[0], 73, t) for t in range(3)]
        assert [same(nested_tuples(a), b) for a, b in zip(model.trees, plain)] == [True] * 3
    known, sent, chunked = models[0].predict_arrays(x), [], forest._chunked
    monkeypatch.setattr(forest, "HELD_NODES", 0)
    monkeypatch.setattr(forest, "_chunked", lambda rows, *a: sent.append(rows.count()) or chunked(rows, *a))
    got = {r.id: r.pred_mean for r in models[0].predict(df, ["id"]).collect()}
    assert sent == [12] and [got[r.id] for r in rows] == pytest.approx(list(known), rel=1e-12)


def test_trees_do_not_depend_on_how_rows_lie(table, arrays):
    """Sums are exact, so that equal gains stay equal in any order of the rows."""
    width = arrays[0].shape[1]
    ready = forest.prepare(table, [F.lit(True)], ["id"], width, max_bins=32)
    a, b = (forest.fit_table(t, [forest.Fit(SETTINGS[0], F.lit(True))])[0].trees for t in (ready, replace(ready, rows=ready.rows.repartition(7, "id"))))
    assert all((u == v).all() for p, q in zip(a, b) for u, v in zip(p, q))
    odd = table.withColumn("t", F.when(F.col("id") == 5, float("nan")).otherwise(F.col("t")))
    assert np.isnan(forest.fit_many(odd, [forest.Fit(forest.Settings(2, 3), F.lit(True))], ["id"], width)[0].predict_arrays(arrays[0])).all()


@pytest.mark.parametrize("holdout_above", [0, 10**9])
def test_trials_of_a_search_share_the_binned_table(spark, monkeypatch, holdout_above):
    df = spark.range(300).select("id", ((F.col("id") * 37 % 300) / 300).alias("a"), (F.col("id") % 3 * 1.0).alias("b"))
    study = nested.prepare(df.withColumn("y", F.sin(6 * F.col("a")) + F.col("b")), ["id"], ["a", "b"], "curve", k_outer=2, k_inner=2)
    configs = [{"n_estimators": n, "max_depth": 6} for n in (2, 3)]
    made, binned = [], forest.binned
    monkeypatch.setattr(forest, "binned", lambda rows, bins, keep, *a: made.append(list(keep)) or binned(rows, bins, keep, *a))
    log = nested.search(study, "GRF", 1, configs, holdout_above=holdout_above).orderBy("number").collect()
    assert [r.state for r in log] == ["COMPLETE"] * 2 and all(0 < r.value < 0.5 for r in log) and made.count(["id", "label", "train"]) == 1
