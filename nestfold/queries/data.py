"""Sources, sinks, projections, encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType, LongType

from nestfold.functions.metrics import floor_variance
from nestfold.operators import encode, trials
from nestfold.queries.base import (
    PART, POLICY_SQL, PRIORITIES, encoded_policies, policies, query, r, table,
)
from nestfold.sources import results, runlog, storage, tables


@query("source_delimited", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def _(spark, d):
    part = table(spark, d, "part")
    indexed = part.select(F.col("p_partkey").alias("index"), "*")
    path = storage.fresh_path(spark, "delimited")
    results.write_csv(indexed, path, sep=";")
    return tables.read_delimited(spark, path, StructType([StructField("index", LongType()), *part.schema.fields]))


@query("source_parquet", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_totalprice > 400000")
def _(spark, d):
    orders = tables.read_parquet(spark, f"{d}/orders.parquet")
    return orders.filter("o_totalprice > 400000").select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("source_named_dataset", """SELECT p_partkey, p_brand, p_type, p_retailprice, 'p_brand,p_type' AS categorical FROM part""")
def _(spark, d):
    registry = tables.Registry()
    registry.add(PART)
    df, _, categorical = registry.load(spark, "parts", path=f"{d}/part.parquet")
    names = ",".join(c for c, flag in categorical.items() if flag)
    return df.withColumn("categorical", F.lit(names))


def _fold_results(spark, d) -> DataFrame:
    scored = policies(spark, d).groupBy("fold").agg(F.avg("y").alias("mse"))
    return scored.select(F.lit("policies").alias("dataset_name"), F.lit("RF").alias("model"),
                         F.col("fold").alias("outer_run"), "mse")


FOLD_RESULTS_SQL = f"""WITH {POLICY_SQL}, fold_results AS (
  SELECT 'policies' AS dataset_name, 'RF' AS model, fold AS outer_run, avg(y) AS mse FROM policy GROUP BY fold)"""


@query("result_log_read_or_empty", FOLD_RESULTS_SQL + """
SELECT dataset_name, model, outer_run, CAST(NULL AS DOUBLE) AS nll_score, round(mse, 4) AS mse FROM fold_results""")
def _(spark, d):
    empty = results.read_log(spark, storage.fresh_path(spark, "no-such-log"))
    log = results.concat_logs([empty, _fold_results(spark, d)])
    return log.select("dataset_name", "model", "outer_run", "nll_score", r("mse", 4).alias("mse"))


@query("result_log_append", FOLD_RESULTS_SQL + """
SELECT dataset_name, model, outer_run, round(mse, 4) AS mse, CAST(NULL AS DOUBLE) AS nll_score FROM fold_results
UNION ALL
SELECT dataset_name, 'DE', outer_run, round(mse / 2, 4), round(mse / 1000, 4) FROM fold_results""")
def _(spark, d):
    first = storage.materialize(_fold_results(spark, d), "fold-results")
    second = first.select("dataset_name", F.lit("DE").alias("model"), "outer_run",
                          (F.col("mse") / 2).alias("mse"), (F.col("mse") / 1000).alias("nll_score"))
    path = storage.fresh_path(spark, "result-log")
    for log in (first, second):
        results.append_log(log, path)
    log = results.read_log(spark, path)
    return log.select("dataset_name", "model", "outer_run", r("mse", 4).alias("mse"), r("nll_score", 4).alias("nll_score"))


@query("run_log_replaces_reruns", FOLD_RESULTS_SQL + """
SELECT dataset_name, model, outer_run, round(mse / outer_run, 4) AS mse FROM fold_results""")
def _(spark, d):
    rows = storage.materialize(_fold_results(spark, d), "fold-results")
    log = runlog.RunLog(spark, storage.fresh_path(spark, "run-log"))
    for attempt in (1, 2):  # the second one takes the place of the first
        for run in range(1, 6):
            part = rows.filter(F.col("outer_run") == run)
            log.write(f"policies|RF|{run}", part.withColumn("mse", F.col("mse") / F.lit(run if attempt == 2 else 1)))
    log.compact()
    return log.read().select("dataset_name", "model", "outer_run", r("mse", 4).alias("mse"))


@query("log_concat_by_name", FOLD_RESULTS_SQL + """
SELECT outer_run, round(mse, 4) AS mse, CAST(NULL AS DOUBLE) AS train_time FROM fold_results
UNION ALL SELECT outer_run, CAST(NULL AS DOUBLE), round(mse / 100, 4) FROM fold_results""")
def _(spark, d):
    a = _fold_results(spark, d).select("outer_run", r("mse", 4).alias("mse"))
    b = _fold_results(spark, d).select("outer_run", r(F.col("mse") / 100, 4).alias("train_time"))
    return results.concat_logs([a, b])


@query("sink_csv", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def _(spark, d):
    path = storage.fresh_path(spark, "csv")
    out = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    results.write_csv(out.limit(0), path)
    results.write_csv(out, path)  # replaces the first one
    return spark.read.schema(out.schema).option("header", True).csv(path)


@query("columns_by_position", "SELECT p_name, p_brand, p_type FROM part")
def _(spark, d):
    return tables.columns_at(table(spark, d, "part"), 1, 4)


@query("target_by_flag", """
SELECT p_partkey, CAST(p_retailprice AS DOUBLE) AS y, 'parts_PPV' AS dataset_name FROM part
UNION ALL SELECT p_partkey, CAST(p_size AS DOUBLE), 'parts_BPV' FROM part""")
def _(spark, d):
    part = table(spark, d, "part")
    both = [tables.choose_target(part, PART, which) for which in ("PPV", "BPV")]
    both = [b.select("p_partkey", F.col("y").cast("double").alias("y"), "dataset_name") for b in both]
    return both[0].unionByName(both[1])


@query("year_offset", "SELECT o_orderkey, CAST(substr(CAST(o_orderdate AS VARCHAR), 1, 4) AS INTEGER) - 1985 AS year_off FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", encode.year_offset("o_orderdate").alias("year_off"))


@query("binary_flag", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_f FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", encode.binary_flag("o_orderstatus", "F").alias("is_f"))


@query("ordinal_encode", """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1
 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 WHEN '5-LOW' THEN 4 END AS priority FROM orders""")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", encode.ordinal("o_orderpriority", PRIORITIES).alias("priority"))


@query("one_hot", """SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
 CASE WHEN l_returnflag = 'A' THEN 1.0::DOUBLE ELSE 0 END AS "l_returnflag=A",
 CASE WHEN l_returnflag = 'N' THEN 1.0::DOUBLE ELSE 0 END AS "l_returnflag=N",
 CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END AS "l_returnflag=R",
 CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0 END AS "l_linestatus=O" FROM lineitem""")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
        "l_returnflag", "l_linestatus")
    return encode.one_hot(rows, encode.one_hot_levels(rows))


@query("encoded_features", f"""WITH {POLICY_SQL}
SELECT o_orderkey, year_off, is_f, priority, c_acctbal, y, fold,
 CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 1.0::DOUBLE ELSE 0 END AS "c_mktsegment=AUTOMOBILE",
 CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0::DOUBLE ELSE 0 END AS "c_mktsegment=BUILDING",
 CASE WHEN c_mktsegment = 'FURNITURE' THEN 1.0::DOUBLE ELSE 0 END AS "c_mktsegment=FURNITURE",
 CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 1.0::DOUBLE ELSE 0 END AS "c_mktsegment=HOUSEHOLD",
 CASE WHEN c_mktsegment = 'MACHINERY' THEN 1.0::DOUBLE ELSE 0 END AS "c_mktsegment=MACHINERY" FROM policy""")
def _(spark, d):
    return encoded_policies(spark, d)[0]


@query("assemble_vector", f"""WITH {POLICY_SQL}, v AS (SELECT o_orderkey, CAST(year_off AS FLOAT) AS a, CAST(is_f AS FLOAT) AS b,
 CAST(priority AS FLOAT) AS c, CAST(c_acctbal AS FLOAT) AS e FROM policy)
SELECT o_orderkey, CAST(4 AS INTEGER) AS length, round(CAST(a AS DOUBLE) + 2 * CAST(b AS DOUBLE) + 3 * CAST(c AS DOUBLE) + CAST(e AS DOUBLE), 4) AS checksum FROM v""")
def _(spark, d):
    v = encode.assemble(policies(spark, d), ["year_off", "is_f", "priority", "c_acctbal"], keep=["o_orderkey"])
    x = lambda i: F.col("features")[i].cast("double")
    return v.select("o_orderkey", F.size("features").alias("length"), r(x(0) + 2 * x(1) + 3 * x(2) + x(3), 4).alias("checksum"))


@query("variance_floor", """SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
 CASE WHEN l_discount - 0.05 > 0 THEN round(l_discount - 0.05, 6) ELSE 0.000001 END AS pred_var FROM lineitem""")
def _(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
        r(floor_variance(F.col("l_discount") - 0.05)).alias("pred_var"))


@query("stored_run", FOLD_RESULTS_SQL + " SELECT outer_run, dataset_name, round(mse, 4) AS mse FROM fold_results WHERE outer_run = 2")
def _(spark, d):
    return trials.stored_run(_fold_results(spark, d), 2).select("outer_run", "dataset_name", r("mse", 4).alias("mse"))


@query("clean_log_types", """SELECT o_orderkey, o_orderkey % 4 IN (0, 2) AS initialize_fe, CAST(o_orderkey % 1000 AS INTEGER) AS outer_run,
 round((o_orderkey % 3) * 86400 + (o_orderkey % 24) * 3600 + (o_orderkey % 60) * 60 + (o_orderkey % 59) + 0.25, 6) AS seconds FROM orders""")
def _(spark, d):
    k = F.col("o_orderkey")
    text = table(spark, d, "orders").select(
        k,
        F.element_at(F.array(*map(F.lit, ("True", "False", "1.0", "0.0"))), (k % 4 + 1).cast("int")).alias("flag"),
        F.concat((k % 1000).cast("string"), F.lit(".0")).alias("whole"),
        F.format_string("%d days %02d:%02d:%02d.250000", k % 3, k % 24, k % 60, k % 59).alias("took"),
    )
    return text.select(k, trials.clean_bool(F.col("flag")).alias("initialize_fe"), trials.clean_int(F.col("whole")).alias("outer_run"),
                       r(trials.duration_seconds(F.col("took"))).alias("seconds"))


@query("number_copies", """SELECT l_returnflag, l_linestatus, l_quantity, l_discount,
 CAST(row_number() OVER (PARTITION BY l_returnflag, l_linestatus, l_quantity, l_discount) AS BIGINT) AS copy_no
FROM (SELECT l_returnflag, l_linestatus, l_quantity, l_discount + 0.0 AS l_discount FROM lineitem)""")
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount")
    return tables.number_copies(rows)
