"""Registry of queries, and the working tables they share.

Every query takes ``(spark, sf_dir)`` and reads whole tables. SQL texts say the
same for an independent engine; they take the plain way (global windows, joins)
where the Spark side takes a scalable one.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from nestfold.functions.keys import order_hash
from nestfold.operators.encode import binary_flag, one_hot, one_hot_levels, ordinal, year_offset
from nestfold.operators.order import time_bucket, with_position
from nestfold.operators.split import with_kfold
from nestfold.sources.storage import materialize
from nestfold.sources.tables import TableSpec

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(column: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; floats of different engines differ in the last digits."""
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")

POLICY = TableSpec(
    name="policies",
    features=("year_off", "is_f", "priority", "c_acctbal", "c_mktsegment"),
    targets={"total": "o_totalprice"},
    key=("o_orderkey",),
)
PART = TableSpec(
    name="parts",
    features=("p_partkey", "p_brand", "p_type"),
    targets={"PPV": "p_retailprice", "BPV": "p_size"},
    key=("p_partkey",),
    default_target="PPV",
)


def policies(spark: SparkSession, sf_dir: str, folds: bool = True) -> DataFrame:
    """Orders with their customer, encoded; fold 1..5 by order key.

    Folds are assigned to the orders before the join, as they depend on the key
    alone, so the cuts are found on one column of one table.
    """
    orders = table(spark, sf_dir, "orders")
    if folds:
        orders = with_kfold(orders, ["o_orderkey"], 5)
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey",
        year_offset("o_orderdate").alias("year_off"),
        binary_flag("o_orderstatus", "F").alias("is_f"),
        ordinal("o_orderpriority", PRIORITIES).alias("priority"),
        "c_acctbal", "c_mktsegment", F.col("o_totalprice").alias("y"),
        *(["fold"] if folds else []),
    )


def encoded_policies(spark: SparkSession, sf_dir: str, folds: bool = True) -> tuple[DataFrame, list[str]]:
    """Policies with one-hot segments, and the names of all feature columns."""
    levels = one_hot_levels(table(spark, sf_dir, "customer"), ["c_mktsegment"])
    df = one_hot(policies(spark, sf_dir, folds), levels)
    return df, [c for c in df.columns if c not in ("o_orderkey", "y", "fold")]


# md5 order and NTILE are what the folds mean.
FOLDS_SQL = "SELECT *, CAST(NTILE(5) OVER (ORDER BY md5('73|' || o_orderkey)) AS INTEGER) AS fold FROM orders"

POLICY_SQL = f"""policy AS (
  SELECT o_orderkey, CAST(substr(CAST(o_orderdate AS VARCHAR), 1, 4) AS INTEGER) - 1985 AS year_off,
    CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_f,
    CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2
      WHEN '4-NOT SPECIFIED' THEN 3 WHEN '5-LOW' THEN 4 END AS priority,
    c_acctbal, c_mktsegment, o_totalprice AS y, fold
  FROM ({FOLDS_SQL}) JOIN customer ON o_custkey = c_custkey)"""


def reports(spark: SparkSession, sf_dir: str, stored: bool = False) -> DataFrame:
    """Events as loss reports: study = event type, trial = user, in time order.

    ``stored`` writes them first, for operators that read a report log several times.
    """
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("study"), F.col("user_id").cast("int").alias("number"),
        "event_id", "ts", "value",
    )
    placed = with_position(events, ["study", "number"], ["ts", "event_id"], time_bucket("ts", "day"))
    placed = placed.withColumn("step", F.col("pos"))
    return materialize(placed, "reports") if stored else placed


def trial_log(reports_df: DataFrame) -> DataFrame:
    """One row per trial: FAIL when its last loss is above 150, COMPLETE with 13 or
    more reports, else PRUNED. A failed trial has no value."""
    last = F.max_by("value", "step")
    state = F.when(last > 150, "FAIL").when(F.count(F.lit(1)) >= 13, "COMPLETE").otherwise("PRUNED")
    return reports_df.groupBy("study", "number").agg(
        state.alias("state"), F.min("value").alias("least"), F.count(F.lit(1)).alias("n_reports"),
        F.min("ts").alias("start"), F.max("ts").alias("end"),
    ).select("study", "number", "state", F.when(F.col("state") != "FAIL", F.col("least")).alias("value"),
             "n_reports", "start", "end")


REPORTS_SQL = """reports AS (
  SELECT event_type AS study, CAST(user_id AS INTEGER) AS number, event_id, ts, value,
    CAST(row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS step
  FROM events)"""

TRIALS_SQL = """trials AS (
  SELECT study, number, CASE WHEN last_value > 150 THEN 'FAIL' WHEN n_reports >= 13 THEN 'COMPLETE' ELSE 'PRUNED' END AS state,
    CASE WHEN last_value > 150 THEN NULL ELSE least_value END AS value, n_reports, start_ts, end_ts
  FROM (SELECT study, number, arg_max(value, step) AS last_value, min(value) AS least_value, count(*) AS n_reports,
          min(ts) AS start_ts, max(ts) AS end_ts FROM reports GROUP BY study, number))"""


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as component predictions of their order."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("row_id"), F.col("l_linenumber").alias("component"),
        (10 * F.log("l_extendedprice")).alias("mean"), (F.sqrt("l_quantity") / 3).alias("var"),
        (-1.0 - F.col("l_discount") * 10).alias("log_weight"), (F.col("l_tax") * 1000).alias("y"),
    )


COMPONENTS_SQL = """components AS (
  SELECT l_orderkey AS row_id, l_linenumber AS component, 10 * ln(l_extendedprice) AS mean, sqrt(l_quantity) / 3 AS var,
    -1.0 - l_discount * 10 AS log_weight, l_tax * 1000 AS y FROM lineitem)"""
