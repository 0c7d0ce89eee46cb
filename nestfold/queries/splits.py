"""Sampling, folds, batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from nestfold.operators import split
from nestfold.queries.base import FOLDS_SQL, query, table

SAMPLE_SHARE = 4  # the sample query takes a quarter of the rows


@query("sample_exact", """SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5('73|' || o_orderkey)) AS i,
 count(*) OVER () AS n FROM orders) WHERE i <= n // 4""")
def _(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey")
    return split.sample_exact(orders, ["o_orderkey"], orders.count() // SAMPLE_SHARE)


@query("kfold", f"SELECT o_orderkey, fold FROM ({FOLDS_SQL})")
def _(spark, d):
    return split.with_kfold(table(spark, d, "orders"), ["o_orderkey"], 5).select("o_orderkey", "fold")


@query("kfold_sizes", """SELECT fold, count(*) AS n FROM (SELECT CAST(NTILE(7) OVER (ORDER BY md5('73|' || event_id)) AS INTEGER) AS fold FROM events) GROUP BY fold""")
def _(spark, d):
    return split.with_kfold(table(spark, d, "events"), ["event_id"], 7).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


NESTED_SQL = f"""outer_folds AS ({FOLDS_SQL}), runs AS (SELECT unnest(range(1, 6)) AS run),
roles AS (
  SELECT o_orderkey, CAST(run AS INTEGER) AS outer_run, CASE WHEN fold = run THEN 'test' ELSE 'train' END AS role,
    CASE WHEN fold <> run THEN CAST(NTILE(4) OVER (PARTITION BY run, fold = run ORDER BY md5('69|' || o_orderkey)) AS INTEGER) END AS inner_fold
  FROM outer_folds, runs)"""


@query("nested_folds", f"WITH {NESTED_SQL} SELECT o_orderkey, outer_run, role, coalesce(inner_fold, 0) AS inner_fold FROM roles")
def _(spark, d):
    nested = split.with_nested_folds(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 5, 4)
    return split.nested_roles(nested).withColumn("inner_fold", F.coalesce("inner_fold", F.lit(0)))


@query("holdout", """SELECT o_orderkey, i <= ceil(0.25 * n) AS is_test FROM (
 SELECT o_orderkey, row_number() OVER (ORDER BY md5('73|' || o_orderkey)) AS i, count(*) OVER () AS n FROM orders)""")
def _(spark, d):
    return split.with_holdout(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])


@query("search_strategy", f"""WITH f AS ({FOLDS_SQL}), s AS (SELECT fold, count(*) AS n FROM f GROUP BY fold)
SELECT fold AS outer_run, CAST((SELECT sum(n) FROM s) - n AS BIGINT) AS train_rows,
 CASE WHEN (SELECT sum(n) FROM s) - n > 100000 THEN 'holdout' ELSE 'cv' END AS strategy FROM s""")
def _(spark, d):
    folded = split.with_kfold(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 5, out="outer_fold")
    return split.search_strategy(folded)


@query("rows_by_id", """SELECT o_orderkey, o_totalprice, 'test' AS role FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
UNION ALL SELECT o_orderkey, o_totalprice, 'train' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def _(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").alias("c_custkey"))
    ids = table(spark, d, "customer").filter("c_acctbal < 0").select("c_custkey")
    keep = ["o_orderkey", "o_totalprice"]
    test = split.take_rows(orders, ids, ["c_custkey"]).select(*keep, F.lit("test").alias("role"))
    train = split.drop_rows(orders, ids, ["c_custkey"]).select(*keep, F.lit("train").alias("role"))
    return test.unionByName(train)


@query("random_subset", """SELECT vec_id FROM (SELECT vec_id, row_number() OVER (ORDER BY md5('73|' || vec_id)) AS i FROM embeddings) WHERE i <= 100""")
def _(spark, d):
    return split.sample_exact(table(spark, d, "embeddings").select("vec_id"), ["vec_id"], 100)


@query("mini_batches", """SELECT o_orderkey, CAST((row_number() OVER (ORDER BY md5('epoch3|' || o_orderkey)) - 1) // 512 AS BIGINT) AS batch FROM orders""")
def _(spark, d):
    return split.with_batches(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 512, epoch=3)


@query("scoring_batches", """SELECT batch, count(*) AS n FROM (SELECT CAST((row_number() OVER (ORDER BY md5('score|' || o_orderkey)) - 1) // 1024 AS BIGINT) AS batch FROM orders) GROUP BY batch""")
def _(spark, d):
    b = split.with_batches(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 1024)
    return b.groupBy("batch").agg(F.count(F.lit(1)).alias("n"))
