import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from nestfold.functions import metrics
from nestfold.operators import encode, mixture, scale, trials
from nestfold.sources import results, storage, tables


def test_delimited_skips_index_and_blank_last_line(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(";a;b\n0;x;1.5\n1;y;2.5\n\n")
    schema = StructType([StructField("i", LongType()), StructField("a", StringType()), StructField("b", DoubleType())])
    df = tables.read_delimited(spark, str(path), schema)
    assert df.columns == ["a", "b"] and [tuple(r) for r in df.orderBy("a").collect()] == [("x", 1.5), ("y", 2.5)]


def test_catalogue_number_names_a_table():
    registry = tables.Registry()
    spec = registry.add(tables.TableSpec("diamonds", ("carat",), {"price": "price"}, ("id",)))
    assert registry.spec(42225) is spec and spec.dataset_name() == "diamonds"


def test_missing_log_is_empty_then_appended(spark):
    path = storage.fresh_path(spark, "log")
    assert results.read_log(spark, path).count() == 0
    row = spark.createDataFrame([("d", "RF", 1, 0.5)], "dataset_name string, model string, outer_run int, mse double")
    results.append_log(row, path)
    results.append_log(row.withColumn("nll_score", F.lit(1.0)), path)
    log = results.read_log(spark, path)
    assert log.count() == 2 and log.filter("nll_score is null").count() == 1


def test_unseen_ordinal_level_stops(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    assert df.limit(1).select(encode.ordinal("c", ["a", "b"]).alias("o")).collect()[0].o == 0
    with pytest.raises(PySparkException, match="unknown level"):
        df.select(encode.ordinal("c", ["a", "b"])).collect()


def test_one_hot_drops_first_of_two_levels_only(spark):
    df = spark.createDataFrame([("a", "x", 1), ("b", "y", 2), ("a", "z", 3)], "two string, three string, n int")
    coded = encode.one_hot(df, encode.one_hot_levels(df))
    assert coded.columns == ["n", "two=b", "three=x", "three=y", "three=z"]
    with pytest.raises(ValueError, match="levels"):
        encode.one_hot_levels(df, max_levels=3)


def test_log_cleaning(spark):
    df = spark.createDataFrame([("True", "1.0", "0 days 00:03:52.923940"), ("0.0", "", "2 days 01:00:00"), (None, None, "?")], "b string, i string, d string")
    got = df.select(trials.clean_bool(F.col("b")), trials.clean_int(F.col("i")), trials.duration_seconds(F.col("d"))).collect()
    assert [tuple(r) for r in got] == [(True, 1, pytest.approx(232.92394)), (False, None, 176400.0), (None, None, None)]


def test_scaling_inverts_and_handles_constant_columns(spark):
    df = spark.createDataFrame([(i % 3 + 1, float(i), 7.0) for i in range(30)], "fold int, x double, c double")
    s = scale.fit(df, ["x", "c"])
    x, c = s.stat("x"), s.stat("c")
    got = s.attach(df).select("x", scale.minmax_inverse(scale.minmax(F.col("x"), x), x).alias("back"),
                              scale.minmax(F.col("c"), c).alias("c0"), scale.standardize(F.col("c"), c).alias("c1")).collect()
    assert all(r.back == pytest.approx(r.x) and r.c0 == 0 and r.c1 == 0 for r in got)


def test_pooled_variance_survives_a_large_offset(spark):
    df = spark.range(300).select((F.col("id") % 3 + 1).alias("fold"), (F.col("id") % 7 + 1e9).alias("x"))
    s = scale.fit(df, ["x"]).table.select("fold", F.col("stats")[0]["std"].alias("std")).collect()
    for r in s:
        want = df.filter(F.col("fold") != r.fold).agg(F.stddev_pop(F.col("x") - 1e9)).collect()[0][0]
        assert r.std == pytest.approx(want, rel=1e-7)  # sums of squares would be off by 10 and more


def test_mixtures_agree(spark):
    rows = [(i, j, float(i + j), 0.5 + j, -1.3862943611198906) for i in range(20) for j in range(4)]
    df = spark.createDataFrame(rows, "row_id int, component int, mean double, var double, log_weight double").withColumn("y", F.lit(3.0))
    a = {r.row_id: r for r in mixture.equal_mixture(df, ["row_id"]).collect()}
    b = {r.row_id: r for r in mixture.weighted_mixture(df, ["row_id"]).collect()}
    top = {r.row_id: r.t for r in df.groupBy("row_id").agg(F.max(metrics.log_marginal(F.col("mean"), F.col("y"), F.col("var"))).alias("t")).collect()}
    dens = {r.row_id: r.log_density for r in mixture.mixture_log_density(df, ["row_id"]).collect()}
    for i in a:
        assert a[i].pred_mean == pytest.approx(b[i].pred_mean) and a[i].pred_var == pytest.approx(b[i].pred_var)
        assert dens[i] <= top[i] + 1e-9


def test_log_sum_exp_far_from_zero(spark):
    df = spark.createDataFrame([(1, -1e6), (1, -1e6), (2, 5000.0), (2, 4000.0), (3, -700.0), (3, -255.9), (3, -256.1)], "r int, l double")
    got = {x.r: x.log_density for x in mixture.log_sum_exp(df, ["r"], F.col("l")).collect()}
    assert got[1] == pytest.approx(-1e6 + 0.6931471805599453, abs=1e-6)
    assert got[2] == pytest.approx(5000.0) and got[3] == pytest.approx(-255.9 + 0.598139, abs=1e-5)


def test_custom_metric_and_nll_floor(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 0.0), (1, 2.0, 2.0, 1.0)], "fold int, pred_mean double, y double, v double")
    got = metrics.score(df, ["fold"], {"bias": lambda p, y: F.avg(p - y)}, var="v").collect()[0]
    import math
    assert got.bias == -0.5
    assert got.nll_score == pytest.approx((0.5 * (math.log(1e-6) + 1e6) + 0) / 2)


def test_package_is_shipped_once(spark):
    from nestfold.session import ship_package

    ship_package(spark)
    ship_package(spark)
    assert sum("nestfold-package" in name for name in spark.sparkContext.listFiles) == 1
