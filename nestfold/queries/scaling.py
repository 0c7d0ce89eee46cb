"""Fold-wise scalers: fitted on training rows, applied to both parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from nestfold.functions.metrics import floor_variance
from nestfold.operators import scale, split
from nestfold.queries.base import POLICY_SQL, policies, query, r, table

COLUMNS = ("c_acctbal", "year_off", "y")

TRAIN_SQL = f"""WITH {POLICY_SQL}, f AS (SELECT DISTINCT fold FROM policy), train AS (
  SELECT f.fold, min(c_acctbal) AS a_min, max(c_acctbal) AS a_max, avg(c_acctbal) AS a_mean, stddev_pop(c_acctbal) AS a_std,
    min(year_off) AS year_min, max(year_off) AS year_max, min(y) AS y_min, max(y) AS y_max, avg(y) AS y_mean, stddev_pop(y) AS y_std,
    count(*) AS n
  FROM f JOIN policy p ON p.fold <> f.fold GROUP BY f.fold)"""


@query("minmax_fit", TRAIN_SQL + """ SELECT fold, a_min, a_max, CAST(year_min AS DOUBLE) AS year_min, CAST(year_max AS DOUBLE) AS year_max, y_min, y_max, n FROM train""")
def _(spark, d):
    s = scale.fit(policies(spark, d), COLUMNS)
    a, year, y = (F.col("stats")[i] for i in range(3))
    return s.table.select("fold", a["min"].alias("a_min"), a["max"].alias("a_max"), year["min"].alias("year_min"),
                          year["max"].alias("year_max"), y["min"].alias("y_min"), y["max"].alias("y_max"), y["n"].cast("bigint").alias("n"))


@query("minmax_apply_test", TRAIN_SQL + """ SELECT o_orderkey, p.fold, round((c_acctbal - a_min) / (a_max - a_min), 6) AS c_acctbal,
 round((CAST(year_off AS DOUBLE) - year_min) / (year_max - year_min), 6) AS year_off FROM policy p JOIN train t ON p.fold = t.fold""")
def _(spark, d):
    rows = policies(spark, d)
    scaled = scale.apply(rows, scale.fit(rows, COLUMNS), ["c_acctbal", "year_off"])
    return scaled.select("o_orderkey", "fold", r("c_acctbal").alias("c_acctbal"), r("year_off").alias("year_off"))


@query("minmax_apply_run", TRAIN_SQL + """ SELECT o_orderkey, CASE WHEN p.fold = 3 THEN 'test' ELSE 'train' END AS role,
 round((c_acctbal - a_min) / (a_max - a_min), 6) AS c_acctbal, round((y - y_min) / (y_max - y_min), 6) AS y
 FROM policy p JOIN train t ON t.fold = 3""")
def _(spark, d):
    rows = policies(spark, d)
    scaled = scale.apply(rows, scale.fit(rows, COLUMNS), ["c_acctbal", "y"], run=3)
    return scaled.select("o_orderkey", F.when(F.col("fold") == 3, "test").otherwise("train").alias("role"),
                         r("c_acctbal").alias("c_acctbal"), r("y").alias("y"))


@query("minmax_inverse", TRAIN_SQL + """ SELECT o_orderkey, round((c_acctbal - a_min) / (a_max - a_min) * (y_max - y_min) + y_min, 4) AS pred_mean
 FROM policy p JOIN train t ON p.fold = t.fold""")
def _(spark, d):
    rows = policies(spark, d)
    s = scale.fit(rows, COLUMNS)
    unit = scale.minmax(F.col("c_acctbal"), s.stat("c_acctbal"))
    return s.attach(rows).select("o_orderkey", r(scale.minmax_inverse(unit, s.stat("y")), 4).alias("pred_mean"))


@query("standardize_fit", TRAIN_SQL + " SELECT fold, round(a_mean, 6) AS a_mean, round(a_std, 6) AS a_std, round(y_mean, 4) AS y_mean, round(y_std, 4) AS y_std FROM train")
def _(spark, d):
    s = scale.fit(policies(spark, d), COLUMNS)
    a, y = F.col("stats")[0], F.col("stats")[2]
    return s.table.select("fold", r(a["mean"]).alias("a_mean"), r(a["std"]).alias("a_std"),
                          r(y["mean"], 4).alias("y_mean"), r(y["std"], 4).alias("y_std"))


@query("standardize_apply", TRAIN_SQL + """ SELECT o_orderkey, p.fold, round((c_acctbal - a_mean) / a_std, 6) AS c_acctbal
 FROM policy p JOIN train t ON p.fold = t.fold""")
def _(spark, d):
    rows = policies(spark, d)
    scaled = scale.apply(rows, scale.fit(rows, ["c_acctbal"]), ["c_acctbal"], how="standard")
    return scaled.select("o_orderkey", "fold", r("c_acctbal").alias("c_acctbal"))


@query("variance_rescale", TRAIN_SQL + """ SELECT o_orderkey, round(0.01 * (1 + year_off / 100) * (y_max - y_min) * (y_max - y_min) / 1000000, 4) AS pred_var_millions
 FROM policy p JOIN train t ON p.fold = t.fold""")
def _(spark, d):
    rows = policies(spark, d)
    s = scale.fit(rows, ["y"])
    var = floor_variance(0.01 * (1 + F.col("year_off") / 100))
    return s.attach(rows).select("o_orderkey", r(scale.rescale_variance(var, s.stat("y")) / 1000000, 4).alias("pred_var_millions"))


@query("scale_to_bounds", """WITH k AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY md5('73|' || vec_id)) AS i, count(*) OVER () AS n FROM embeddings),
e AS (SELECT vec_id, i <= ceil(0.25 * n) AS is_test, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim FROM k),
b AS (SELECT dim, min(CAST(x AS DOUBLE)) AS lo, max(CAST(x AS DOUBLE)) AS hi FROM e WHERE NOT is_test GROUP BY dim),
u AS (SELECT vec_id, dim, least(greatest((CAST(x AS DOUBLE) - lo) / (hi - lo), 0.0), 1.0) AS u FROM e JOIN b USING (dim))
SELECT vec_id, round(sum(u), 6) AS unit_sum, round(sum(2 * u - 1), 6) AS centred_sum, round(min(u), 6) AS unit_min, round(max(u), 6) AS unit_max FROM u GROUP BY vec_id""")
def _(spark, d):
    rows = split.with_holdout(table(spark, d, "embeddings").select("vec_id", "embedding"), ["vec_id"])
    bounds = scale.array_bounds(rows.filter("not is_test"), "embedding").collect()[0]  # one row, as long as a vector
    lo, hi = F.lit(list(bounds.lo)), F.lit(list(bounds.hi))
    v = rows.select("vec_id", scale.scale_to_bounds(F.col("embedding"), lo, hi).alias("u"),
                    scale.scale_to_bounds(F.col("embedding"), lo, hi, -1.0, 1.0).alias("c"))
    total = lambda c: F.reduce(c, F.lit(0.0), lambda a, x: a + x)
    return v.select("vec_id", r(total("u")).alias("unit_sum"), r(total("c")).alias("centred_sum"),
                    r(F.array_min("u")).alias("unit_min"), r(F.array_max("u")).alias("unit_max"))
