"""Metrics per outer fold, and mixtures of component predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from nestfold.functions import merged, metrics
from nestfold.operators import mixture, scale, split
from nestfold.queries.base import (
    COMPONENTS_SQL, POLICY_SQL, REPORTS_SQL, TRIALS_SQL, components, policies, query, r, reports, table, trial_log,
)
from nestfold.sources.storage import materialize


def fold_mean_predictions(spark, d) -> DataFrame:
    """In thousands: the training mean as prediction, the training variance as variance."""
    rows = policies(spark, d).withColumn("y", F.col("y") / 1000)
    scaler = scale.fit(rows, ["y"])
    joined, s = scaler.attach(rows.select("o_orderkey", "fold", "y", "c_acctbal")), scaler.stat("y")
    return joined.select("o_orderkey", "fold", "y", "c_acctbal", s["mean"].alias("pred_mean"),
                         (s["std"] * s["std"]).alias("pred_var"))


PRED_SQL = f"""WITH {POLICY_SQL}, f AS (SELECT DISTINCT fold FROM policy), train AS (
  SELECT f.fold, avg(p.y / 1000) AS m, var_pop(p.y / 1000) AS v FROM f JOIN policy p ON p.fold <> f.fold GROUP BY f.fold),
pred AS (SELECT o_orderkey, p.fold, p.y / 1000 AS y, c_acctbal, t.m AS pred_mean, t.v AS pred_var FROM policy p JOIN train t ON p.fold = t.fold)
"""


@query("fold_mean_scores", PRED_SQL + """SELECT fold, round(avg(pow(pred_mean - y, 2)), 4) AS mse, round(avg(abs(pred_mean - y)), 4) AS mae,
 round(max(abs(pred_mean - y)), 4) AS max_absolute_error, round(avg(0.5 * (ln(pred_var) + pow(pred_mean - y, 2) / pred_var)), 6) AS nll_score
FROM pred GROUP BY fold""")
def _(spark, d):
    s = metrics.score(fold_mean_predictions(spark, d), ["fold"], var="pred_var")
    return s.select("fold", *[r(c, 4).alias(c) for c in ("mse", "mae", "max_absolute_error")], r("nll_score").alias("nll_score"))


@query("metric_mse", PRED_SQL + "SELECT fold, round(avg(pow(c_acctbal / 10 - y, 2)), 4) AS mse FROM pred GROUP BY fold")
def _(spark, d):
    p = fold_mean_predictions(spark, d).withColumn("pred_mean", F.col("c_acctbal") / 10)
    return metrics.score(p, ["fold"], ["mse"]).select("fold", r("mse", 4).alias("mse"))


@query("metric_mae", PRED_SQL + "SELECT fold, round(avg(abs(c_acctbal / 10 - y)), 4) AS mae FROM pred GROUP BY fold")
def _(spark, d):
    p = fold_mean_predictions(spark, d).withColumn("pred_mean", F.col("c_acctbal") / 10)
    return metrics.score(p, ["fold"], ["mae"]).select("fold", r("mae", 4).alias("mae"))


@query("metric_max_error", PRED_SQL + "SELECT fold, round(max(abs(c_acctbal / 10 - y)), 4) AS max_absolute_error FROM pred GROUP BY fold")
def _(spark, d):
    p = fold_mean_predictions(spark, d).withColumn("pred_mean", F.col("c_acctbal") / 10)
    return metrics.score(p, ["fold"], ["max_absolute_error"]).select("fold", r("max_absolute_error", 4).alias("max_absolute_error"))


# Balances of zero and less are variances at the floor; their terms are huge, so the scores are told in 10^12.
@query("metric_gaussian_nll", PRED_SQL + """SELECT fold, CAST(count_if(c_acctbal <= 0.000001) AS BIGINT) AS n_at_floor, round(avg(0.5 * (ln(v) + pow(pred_mean - y, 2) / v)) / 1e12, 6) AS nll_score,
 round(avg(CASE WHEN c_acctbal > 1 THEN 0.5 * (ln(v) + pow(pred_mean - y, 2) / v) / 1e3 END), 4) AS nll_above
 FROM (SELECT *, greatest(c_acctbal, 0.000001::DOUBLE) AS v FROM pred) GROUP BY fold""")
def _(spark, d):
    p = fold_mean_predictions(spark, d)
    rows = metrics.gaussian_nll_row(F.col("pred_mean"), F.col("y"), F.col("c_acctbal"))
    parts = p.groupBy("fold").agg(
        F.count_if(F.col("c_acctbal") <= metrics.VARIANCE_FLOOR).alias("n_at_floor"),
        r(F.avg(F.when(F.col("c_acctbal") > 1, rows / 1e3)), 4).alias("nll_above"))
    return metrics.score(p, ["fold"], [], var="c_acctbal").select("fold", r(F.col("nll_score") / 1e12).alias("nll_score")).join(parts, "fold")


@query("macro_mean_of_folds", PRED_SQL + """SELECT 'policies' AS dataset_name, round(avg(mse), 4) AS mse, round(avg(mae), 4) AS mae
 FROM (SELECT fold, avg(pow(pred_mean - y, 2)) AS mse, avg(abs(pred_mean - y)) AS mae FROM pred GROUP BY fold)""")
def _(spark, d):
    s = metrics.score(fold_mean_predictions(spark, d), ["fold"], ["mse", "mae"]).withColumn("dataset_name", F.lit("policies"))
    return metrics.macro_mean(s, ["dataset_name"], ["mse", "mae"]).select("dataset_name", r("mse", 4).alias("mse"), r("mae", 4).alias("mae"))


@query("metric_signs_and_roots", PRED_SQL + "SELECT fold, round(-avg(pow(pred_mean - y, 2)), 4) AS neg_mse, round(sqrt(avg(pow(pred_mean - y, 2))), 4) AS rmse FROM pred GROUP BY fold")
def _(spark, d):
    s = metrics.score(fold_mean_predictions(spark, d), ["fold"], ["neg_mse", "rmse"])
    return s.select("fold", r("neg_mse", 4).alias("neg_mse"), r("rmse", 4).alias("rmse"))


@query("epoch_loss", """WITH b AS (
 SELECT 1 AS epoch, (row_number() OVER (ORDER BY md5('epoch1|' || o_orderkey)) - 1) // 1000 AS batch, o_totalprice / 1000 AS loss FROM orders
 UNION ALL SELECT 2, (row_number() OVER (ORDER BY md5('epoch2|' || o_orderkey)) - 1) // 1000, o_totalprice / 1000 FROM orders)
SELECT CAST(epoch AS INTEGER) AS epoch, round(avg(m), 6) AS epoch_loss FROM (SELECT epoch, batch, avg(loss) AS m FROM b GROUP BY epoch, batch) GROUP BY epoch""")
def _(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("loss"))
    epochs = [split.with_batches(orders, ["o_orderkey"], 1000, epoch=e).withColumn("epoch", F.lit(e)) for e in (1, 2)]
    out = metrics.epoch_loss(epochs[0].unionByName(epochs[1]), ["epoch"], "batch", "loss")
    return out.select("epoch", r("epoch_loss").alias("epoch_loss"))


@query("run_durations", f"""WITH {REPORTS_SQL}, {TRIALS_SQL}, s AS (SELECT study, state, epoch_us(end_ts) - epoch_us(start_ts) AS us FROM trials)
SELECT study, state, count(*) AS trials, round(avg(us / 1000000), 3) AS mean_seconds, round(min(us / 1000000), 3) AS min_seconds, round(max(us / 1000000), 3) AS max_seconds FROM s GROUP BY study, state""")
def _(spark, d):
    seconds = metrics.seconds_between(F.col("start"), F.col("end"))
    log = trial_log(reports(spark, d)).withColumn("seconds", seconds)
    return log.groupBy("study", "state").agg(
        F.count(F.lit(1)).alias("trials"), r(F.avg("seconds"), 3).alias("mean_seconds"),
        r(F.min("seconds"), 3).alias("min_seconds"), r(F.max("seconds"), 3).alias("max_seconds"))


@query("custom_metric", PRED_SQL + "SELECT fold, round(avg(abs(pred_mean - y) / (1 + abs(y))), 6) AS relative_error FROM pred GROUP BY fold")
def _(spark, d):
    def relative_error(pred: Column, y: Column) -> Column:
        return F.avg(F.abs(pred - y) / (1 + F.abs(y)))

    s = metrics.score(fold_mean_predictions(spark, d), ["fold"], {"relative_error": relative_error})
    return s.select("fold", r("relative_error").alias("relative_error"))


@query("merged_metric", PRED_SQL + "SELECT fold, round(1 - avg(pow(c_acctbal / 10 - y, 2)) / var_pop(y), 6) AS r_squared FROM pred GROUP BY fold")
def _(spark, d):
    p = fold_mean_predictions(spark, d).withColumn("pred_mean", F.col("c_acctbal") / 10)
    return merged.score(p, ["fold"], {"r_squared": merged.r_squared()}).select("fold", r("r_squared").alias("r_squared"))


@query("median_error", PRED_SQL + "SELECT fold, round(median(abs(pred_mean - y)), 6) AS median_error FROM pred GROUP BY fold")
def _(spark, d):
    rows = materialize(fold_mean_predictions(spark, d).select("fold", "pred_mean", "y"), "errors")  # several passes read them
    return merged.exact_median_error(rows, ["fold"]).select("fold", r("median_error").alias("median_error"))


# -- mixtures --------------------------------------------------------------------

def _moments(df: DataFrame) -> DataFrame:
    return df.select("row_id", r("pred_mean").alias("pred_mean"), r(metrics.floor_variance(F.col("pred_var")), 4).alias("pred_var"))


@query("equal_mixture", f"""WITH {COMPONENTS_SQL}
SELECT row_id, round(m, 6) AS pred_mean, round(CASE WHEN v > 0 THEN v ELSE 0.000001 END, 4) AS pred_var
FROM (SELECT row_id, avg(mean) AS m, avg(var + mean * mean) - avg(mean) * avg(mean) AS v FROM components GROUP BY row_id)""")
def _(spark, d):
    return _moments(mixture.equal_mixture(components(spark, d), ["row_id"]))


WEIGHTS_SQL = COMPONENTS_SQL + """, weights AS (SELECT component, ln(count(*) / (SELECT count(*) FROM components)) AS w FROM components GROUP BY component)"""


def _weights(rows: DataFrame) -> DataFrame:
    """Share of each component number among all rows, as log weight."""
    counts = rows.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    total = rows.count()
    return counts.select("component", F.log(F.col("n") / F.lit(total)).alias("log_weight"))


@query("weighted_mixture", f"""WITH {WEIGHTS_SQL}
SELECT row_id, round(m, 6) AS pred_mean, round(CASE WHEN v > 0 THEN v ELSE 0.000001 END, 4) AS pred_var FROM (
 SELECT row_id, sum(exp(w) * mean) AS m, sum(exp(w) * (var + mean * mean)) - sum(exp(w) * mean) * sum(exp(w) * mean) AS v
 FROM components JOIN weights USING (component) GROUP BY row_id)""")
def _(spark, d):
    rows = components(spark, d).drop("log_weight")
    return _moments(mixture.weighted_mixture(mixture.attach_weights(rows, _weights(rows)), ["row_id"]))


@query("mixture_log_density", f"""WITH {COMPONENTS_SQL}, l AS (
 SELECT row_id, log_weight - 0.5 * (ln(2 * pi() * var) + (y - mean) * (y - mean) / var) AS l FROM components),
m AS (SELECT row_id, max(l) AS mx FROM l GROUP BY row_id)
SELECT row_id, round(mx + ln(sum(exp(l - mx))), 5) AS log_density FROM l JOIN m USING (row_id) GROUP BY row_id, mx""")
def _(spark, d):
    out = mixture.mixture_log_density(components(spark, d), ["row_id"])
    return out.select("row_id", r("log_density", 5).alias("log_density"))


@query("sample_average", f"""WITH {COMPONENTS_SQL}
SELECT row_id, round(avg(mean), 6) AS pred_mean, round(avg(var), 4) AS pred_var FROM components GROUP BY row_id""")
def _(spark, d):
    return _moments(mixture.sample_average(components(spark, d), ["row_id"]))


@query("log_marginal", f"""WITH {COMPONENTS_SQL}
SELECT row_id, component, round(-0.5 * (ln(2 * pi() * var) + (y - mean) * (y - mean) / var), 5) AS log_p FROM components""")
def _(spark, d):
    rows = components(spark, d)
    return rows.select("row_id", "component", r(metrics.log_marginal(F.col("mean"), F.col("y"), F.col("var")), 5).alias("log_p"))
