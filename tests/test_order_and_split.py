import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import Window, functions as F

from nestfold.functions.keys import order_hash
from nestfold.operators import split
from nestfold.operators.order import prefix_length, running, value_band, with_rank
from nestfold.sources.tables import number_copies


def rows_of(spark, n):
    return spark.range(n).withColumnRenamed("id", "k")


@pytest.mark.parametrize("n,k", [(103, 5), (7, 7), (5, 5), (3, 5), (1000, 4)])
def test_fold_sizes_differ_by_one(spark, n, k):
    sizes = {r.fold: r["count"] for r in split.with_kfold(rows_of(spark, n), ["k"], k).groupBy("fold").count().collect()}
    want = [n // k + (i < n % k) for i in range(k)]
    assert [sizes.get(i + 1, 0) for i in range(k)] == want


def test_nested_folds_stay_inside_training_parts(spark):
    nested = split.with_nested_folds(rows_of(spark, 503), ["k"], 5, 4).collect()
    for run in range(1, 6):
        inner = [r.inner_folds[run - 1] for r in nested]
        assert all((f is None) == (r.outer_fold == run) for f, r in zip(inner, nested))
        sizes = [inner.count(i) for i in range(1, 5)]
        n = sum(sizes)
        assert sizes == [n // 4 + (i < n % 4) for i in range(4)]


def test_roles_cover_each_row_once_as_test(spark):
    roles = split.nested_roles(split.with_nested_folds(rows_of(spark, 100), ["k"], 5, 4))
    per_row = roles.groupBy("k").agg(F.sum((F.col("role") == "test").cast("int")).alias("t"), F.count("*").alias("n")).collect()
    assert all(r.t == 1 and r.n == 5 for r in per_row)


@pytest.mark.parametrize("n", [1, 4, 101])
def test_holdout_and_sample_sizes(spark, n):
    df = rows_of(spark, n)
    assert split.with_holdout(df, ["k"]).filter("is_test").count() == -(-n // 4)
    assert split.sample_exact(df, ["k"], 10).count() == min(10, n)
    assert split.sample_exact(df, ["k"], 0).count() == 0


def test_repeated_keys_are_refused(spark):
    df = rows_of(spark, 30).withColumn("k", F.lit(1))
    with pytest.raises(ValueError, match="not unique"):
        split.with_kfold(df, ["k"], 5)


def test_copies_make_a_key_of_a_hot_row(spark):
    """A third of all rows is one row; numbered in chunks of 7, then split evenly."""
    df = rows_of(spark, 300).select(F.when(F.col("k") < 100, -1).otherwise(F.col("k")).alias("v"))
    numbered = number_copies(df, chunk=7)
    got = numbered.groupBy("v").agg(F.count("*").alias("n"), F.countDistinct("copy_no").alias("d"), F.max("copy_no").alias("m"))
    assert all(r.n == r.d == r.m == (100 if r.v == -1 else 1) for r in got.collect())
    folds = split.with_kfold(numbered, ["v", "copy_no"], 5).groupBy("fold").count().collect()
    assert {r["count"] for r in folds} == {60}


def test_rank_is_a_permutation(spark):
    ranked = with_rank(rows_of(spark, 1000), order_hash("x", "k"))
    plain = rows_of(spark, 1000).withColumn("want", F.row_number().over(Window.orderBy(order_hash("x", "k"))))
    assert ranked.join(plain, "k").filter("rank <> want").count() == 0


def test_batches_last_one_short(spark):
    sizes = split.with_batches(rows_of(spark, 1000), ["k"], 300, epoch=1).groupBy("batch").count().collect()
    assert sorted((r.batch, r["count"]) for r in sizes) == [(0, 300), (1, 300), (2, 300), (3, 100)]


def test_running_equals_plain_window_on_a_hot_group(spark):
    df = rows_of(spark, 2000).select(
        F.when(F.col("k") % 3 == 0, F.col("k") % 17).otherwise(0).alias("g"), "k",
        (F.hash("k") % 1000).cast("double").alias("x"))
    got = running(df, ["g"], F.floor(F.col("k") / 100), ["k"], sums={"s": F.col("x")}, minima={"lo": F.col("x")}, maxima={"hi": F.col("x")})
    w = Window.partitionBy("g").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("g", "k", F.coalesce(F.sum("x").over(w), F.lit(0.0)).alias("s2"), F.min("x").over(w).alias("lo2"), F.max("x").over(w).alias("hi2"))
    both = got.join(want, ["g", "k"])
    assert both.count() == 2000
    assert both.filter("not (s <=> s2 and lo <=> lo2 and hi <=> hi2)").count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=32), min_size=2, max_size=30))
def test_value_bands_grow_with_values(spark, values):
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", value_band(F.col("v")).alias("b")).collect()
    ordered = sorted(rows, key=lambda r: r.v)
    assert all(a.b <= b.b for a, b in zip(ordered, ordered[1:]))


def test_prefix_grows_with_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "20000")
        assert prefix_length(rows_of(spark, 1)) == 5
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
