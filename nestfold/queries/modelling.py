"""Models, searches and nested runs on the part table (and kernels on embeddings)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from nestfold.functions.kernels import kernel_column
from nestfold.models import gp, hist, joint, net, store, tuned
from nestfold.operators import scale, space
from nestfold.operators.encode import one_hot, one_hot_levels
from nestfold.plans import nested, running
from nestfold.queries.base import encoded_policies, query, r, table
from nestfold.sources import results, storage

FOREST = {"n_estimators": 20, "max_depth": 10, "min_samples_split": 2, "min_samples_leaf": 2, "max_features": "auto"}
BOOSTED = {"n_estimators": 15, "max_depth": 5, "learning_rate": 0.1, "subsample": 0.8, "colsample_bytree": 0.6,
           "min_child_weight": 2, "gamma": 0.0, "reg_alpha": 0.01, "reg_lambda": 1.0}
ENSEMBLE = {"n_max": 32, "n_layers": 3, "lr": 0.01, "batch_size": 128, "epochs": 12, "n_members": 5}
DEEP_KERNEL = {"n_max": 32, "n_layers": 3, "n_out": 2, "mean_type": "linear", "kernel_type": "matern1.5", "num_inducing": 50, "lr": 0.01, "epochs": 5}
SPARSE_GP = {"num_inducing": 50, "kernel_type": "rbf", "mean_type": "constant", "minit": "kmeans"}


def parts(spark, d) -> tuple[DataFrame, list[str]]:
    """Part prices (in hundreds above 900) with key, brand and type as features."""
    part = table(spark, d, "part").select("p_partkey", F.col("p_partkey").cast("double").alias("number"), "p_brand", "p_type",
                                          (F.col("p_retailprice") / 100 - 9).alias("y"))
    coded = one_hot(part, one_hot_levels(part))
    return coded, [c for c in coded.columns if c not in ("p_partkey", "y")]


def part_study(spark, d) -> nested.Study:
    df, features = parts(spark, d)
    return nested.prepare(df, ["p_partkey"], features, "parts_PPV")


def _outer_scores(spark, d, model, params) -> DataFrame:
    study = part_study(spark, d)
    rows, _ = nested.evaluate(study, model, {run: params for run in range(1, study.k_outer + 1)})
    return rows.drop("params")


@query("forest_outer_scores")
def _(spark, d):
    return _outer_scores(spark, d, "RF", FOREST)


@query("grown_forest_outer_scores")
def _(spark, d):
    """Forests with depths and split sizes beyond what MLlib runs, all outer runs in the same passes."""
    return _outer_scores(spark, d, "GRF", {**FOREST, "max_depth": 100, "min_samples_split": 5, "max_features": "sqrt"})


@query("boosted_outer_scores")
def _(spark, d):
    return _outer_scores(spark, d, "XGB", BOOSTED)


def _sized_parts(spark, d) -> tuple[DataFrame, hist.Bins]:
    """Parts with two features and their cut points; the price in hundreds above 900 as target."""
    rows = table(spark, d, "part").select(
        F.array(F.col("p_size").cast("double"), (F.col("p_partkey") % 100).cast("double")).alias("features"),
        (F.col("p_retailprice") / 100 - 9).alias("y"))
    return rows, hist.Bins((np.array([10.0, 20.0, 30.0, 40.0]), np.array([24.5, 49.5, 74.5])))


HISTOGRAM_SQL = """h AS (
  SELECT feature, bin, sum(-y) AS g, CAST(count(*) AS DOUBLE) AS h FROM (
    SELECT 0 AS feature, CASE WHEN p_size <= 10 THEN 0 WHEN p_size <= 20 THEN 1 WHEN p_size <= 30 THEN 2 WHEN p_size <= 40 THEN 3 ELSE 4 END AS bin,
      p_retailprice / 100 - 9 AS y FROM part
    UNION ALL SELECT 1, CASE WHEN p_partkey % 100 <= 24.5 THEN 0 WHEN p_partkey % 100 <= 49.5 THEN 1 WHEN p_partkey % 100 <= 74.5 THEN 2 ELSE 3 END,
      p_retailprice / 100 - 9 FROM part) GROUP BY feature, bin)"""


@query("boosting_histogram", f"WITH {HISTOGRAM_SQL} SELECT feature, bin, round(g, 6) AS gradient, h AS curvature FROM h")
def _(spark, d):
    rows, bins = _sized_parts(spark, d)
    sums = hist.root_sums(rows, bins)
    places = [(f, b) for f, n in enumerate(bins.sizes.tolist()) for b in range(n)]
    out = [(f, b, round(float(g), 6), float(h)) for (f, b), (g, h) in zip(places, sums) if h]
    return spark.createDataFrame(out, "feature int, bin int, gradient double, curvature double")


def _score_sql(g: str, h: str) -> str:
    return f"pow(sign({g}) * greatest(abs({g}) - 0.5, 0), 2) / ({h} + 2)"


@query("boosting_root_split", f"""WITH {HISTOGRAM_SQL},
 s AS (SELECT feature, bin, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER (PARTITION BY feature) AS gt, sum(h) OVER (PARTITION BY feature) AS ht
   FROM h WINDOW w AS (PARTITION BY feature ORDER BY bin)),
 x AS (SELECT *, {_score_sql("gl", "hl")} + {_score_sql("(gt - gl)", "(ht - hl)")} - {_score_sql("gt", "ht")} AS gain FROM s WHERE hl >= 3 AND ht - hl >= 3)
SELECT feature, bin, round(gain, 4) AS gain, round(-sign(gt) * greatest(abs(gt) - 0.5, 0) / (ht + 2), 6) AS leaf FROM x
 QUALIFY row_number() OVER (ORDER BY gain DESC, feature, bin) = 1""")
def _(spark, d):
    rows, bins = _sized_parts(spark, d)
    sums = hist.root_sums(rows, bins)
    gain, feature, cut = hist.best_splits(sums[None], bins, np.ones(2, bool), 0.5, 2.0, 3.0)
    g, h = sums[:int(bins.sizes[0])].sum(axis=0)
    out = [(int(feature[0]), int(cut[0]), round(float(gain[0]), 4), round(hist.leaf_value(g, h, 0.5, 2.0), 6))]
    return spark.createDataFrame(out, "feature int, bin int, gain double, leaf double")


@query("boosted_cv_search")
def _(spark, d):
    """Two configurations of the boosted trees' own ranges for steps and penalties, each stopped by its inner folds."""
    configs = [{**BOOSTED, "learning_rate": 0.3, "reg_alpha": 0.01, "reg_lambda": 1.0, "n_estimators": 30},
               {**BOOSTED, "learning_rate": 0.1, "max_depth": 3, "reg_alpha": 1.0, "reg_lambda": 10.0, "n_estimators": 30}]
    log = nested.search(part_study(spark, d), "XGB", 1, configs, holdout_above=10**12)
    return log.select("outer_cv_split", "number", "value", "metric", "max_epochs", "state")


@query("running_search")
def _(spark, d):
    """Six networks under hyperband: the trial log of a search that trains them together."""
    study = part_study(spark, d)
    configs = [{**ENSEMBLE, "n_max": 16, "n_members": 2, "lr": lr} for lr in (0.03, 0.01, 0.003, 0.001, 0.0003, 0.0001)]
    rules = running.Rules(epochs=9, patience=3, pruner="hyperband")
    log = nested.search(study, "DE", 1, configs, holdout_above=0, rules=rules)
    return log.select("outer_cv_split", "number", "value", "metric", "max_epochs", "train_losses", "state")


@query("ensemble_outer_scores")
def _(spark, d):
    return _outer_scores(spark, d, "DE", ENSEMBLE)


@query("sparse_gp_outer_scores")
def _(spark, d):
    return _outer_scores(spark, d, "SGP", SPARSE_GP)


@query("deep_kernel_outer_scores")
def _(spark, d):
    return _outer_scores(spark, d, "VDKL", DEEP_KERNEL)


def _arrays(spark, d) -> DataFrame:
    """Embeddings as features, their label as target."""
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("features"), F.col("label").cast("double").alias("y"))


@query("mean_variance_network")
def _(spark, d):
    rows = _arrays(spark, d)
    fitted = net.fit(rows, net.mean_variance_net(64, 32, 3), n_members=1, lr=0.002, epochs=5, batch_size=64)
    return fitted.predict(rows, ["vec_id", "y"])


@query("synchronous_network")
def _(spark, d):
    """A network trained by synchronous mini-batch steps, the same for any partitioning of the embeddings."""
    rows = _arrays(spark, d)
    fitted = net.fit(rows, net.mean_variance_net(64, 16, 2), n_members=2, lr=0.01, epochs=2, batch_size=256, sync="steps", key=["vec_id"], shards=2)
    return fitted.predict(rows, ["vec_id", "y"])


@query("full_gradient_network")
def _(spark, d):
    rows = _arrays(spark, d)
    fitted = net.fit(rows, net.mean_variance_net(64, 16, 2), n_members=2, lr=0.01, epochs=5, sync="gradient")
    return fitted.predict(rows, ["vec_id", "y"])


@query("ensemble_components")
def _(spark, d):
    rows = _arrays(spark, d)
    fitted = net.fit(rows, net.mean_variance_net(64, 16, 2), n_members=5, lr=0.01, epochs=2, batch_size=64)
    return fitted.components(rows, ["vec_id"])


@query("extractor_features")
def _(spark, d):
    rows = _arrays(spark, d)
    fitted = net.pretrain_extractor(rows, 64, 32, 3, 4, epochs=5)
    return fitted.transform(rows, ["vec_id"])


def _points_sql(n: int) -> str:
    return f"points AS (SELECT CAST(i - 1 AS INTEGER) AS point, embedding AS p FROM (SELECT embedding, row_number() OVER (ORDER BY md5('73|' || vec_id)) AS i FROM embeddings) WHERE i <= {n})"


@query("kernel_columns", f"""WITH {_points_sql(3)}, x AS (
 SELECT vec_id, point, sqrt(list_sum(list_transform(range(1, 65), lambda k: pow((CAST(embedding[k] AS DOUBLE) - CAST(p[k] AS DOUBLE)) / 0.5, 2)))) AS dist FROM embeddings, points)
SELECT vec_id, point, round(exp(-dist * dist / 2), 6) AS rbf, round(exp(-dist), 6) AS matern05,
 round((1 + sqrt(3) * dist) * exp(-sqrt(3) * dist), 6) AS matern15, round((1 + sqrt(5) * dist + 5 * dist * dist / 3) * exp(-sqrt(5) * dist), 6) AS matern25 FROM x""")
def _(spark, d):
    rows = _arrays(spark, d)
    points = gp.random_points(rows, ["vec_id"], 3)
    kinds = {"rbf": "rbf", "matern05": "matern0.5", "matern15": "matern1.5", "matern25": "matern2.5"}
    per_point = F.array(*[
        F.struct(F.lit(i).alias("point"), *[r(kernel_column(kind, F.col("features"), p, [0.5] * 64)).alias(name) for name, kind in kinds.items()])
        for i, p in enumerate(points)
    ])
    return rows.select("vec_id", F.explode(per_point).alias("k")).select("vec_id", "k.*")


@query("lloyd_step", f"""WITH {_points_sql(8)}, x AS (
 SELECT vec_id, embedding, point, list_sum(list_transform(range(1, 65), lambda k: pow(CAST(embedding[k] AS DOUBLE) - CAST(p[k] AS DOUBLE), 2))) AS dist FROM embeddings, points),
near AS (SELECT vec_id, any_value(embedding) AS embedding, arg_min(point, dist) AS centre FROM x GROUP BY vec_id),
u AS (SELECT centre, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS dim FROM near),
m AS (SELECT centre, dim, avg(CAST(v AS DOUBLE)) AS v FROM u GROUP BY centre, dim)
SELECT centre, CAST((SELECT count(*) FROM near n WHERE n.centre = m.centre) AS BIGINT) AS n, round(sum(v), 6) AS total, round(sum(v * v), 6) AS squares FROM m GROUP BY centre""")
def _(spark, d):
    rows = _arrays(spark, d)
    centres, n = gp.lloyd_step(rows, gp.random_points(rows, ["vec_id"], 8))
    out = [(i, int(n[i]), round(float(c.sum()), 6), round(float((c * c).sum()), 6)) for i, c in enumerate(centres)]
    return spark.createDataFrame(out, "centre int, n bigint, total double, squares double")


@query("kmeans_inducing_points")
def _(spark, d):
    points = gp.kmeans_points(_arrays(spark, d), ["vec_id"], 20, steps=5)
    return spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "point int, location array<double>")


@query("constant_mean", "SELECT round(avg(o_totalprice / 1000), 6) AS intercept FROM orders")
def _(spark, d):
    rows = table(spark, d, "orders").select((F.col("o_totalprice") / 1000).alias("y"))
    return spark.createDataFrame([(round(gp.fit_mean(rows).intercept, 6),)], "intercept double")


@query("linear_mean", """SELECT round(regr_intercept(p_retailprice, p_partkey / 1000), 4) AS intercept, round(regr_slope(p_retailprice, p_partkey / 1000), 4) AS slope FROM part""")
def _(spark, d):
    rows = table(spark, d, "part").select(F.array(F.col("p_partkey") / 1000).alias("features"), F.col("p_retailprice").alias("y"))
    mean = gp.fit_mean(rows, "linear")
    return spark.createDataFrame([(round(mean.intercept, 4), round(float(mean.slopes[0]), 4))], "intercept double, slope double")


def _embedding_gp(rows) -> gp.SparseGP:
    spread = gp.feature_spread(rows) * np.sqrt(64)
    return gp.fit(rows, gp.random_points(rows, ["vec_id"], 50), gp.candidate_kernels("matern1.5", spread), gp.fit_mean(rows))


@query("batched_scoring")
def _(spark, d):
    rows = _arrays(spark, d)
    return _embedding_gp(rows).score_rows(rows, ["vec_id"])


@query("spectral_mixture_gp")
def _(spark, d):
    rows = _arrays(spark, d)
    kernels = gp.spectral_kernels(gp.feature_spread(rows) * np.sqrt(64), 4)
    model = gp.fit(rows, gp.random_points(rows, ["vec_id"], 50), kernels, gp.fit_mean(rows))
    return model.predict(rows, ["vec_id", "y"])


@query("tuned_gp")
def _(spark, d):
    """The bound of a GP while its length scales and points follow the gradient, from the best of fixed factors."""
    rows = _arrays(spark, d)
    _, bounds = tuned.fit(rows, _embedding_gp(rows), steps=5)
    return spark.createDataFrame(list(enumerate(bounds)), "step int, bound double")


@query("model_round_trip", "SELECT vec_id, true AS same FROM embeddings")
def _(spark, d):
    rows = _arrays(spark, d)
    model = _embedding_gp(rows)
    path = storage.fresh_path(spark, "gp")
    store.save_gp(spark, path, model)
    before = model.predict(rows, ["vec_id"])
    after = store.load_gp(spark, path).predict(rows, ["vec_id"]).select("vec_id", F.col("pred_mean").alias("m"), F.col("pred_var").alias("v"))
    return before.join(after, "vec_id").select("vec_id", ((F.abs(F.col("pred_mean") - F.col("m")) < 1e-9) & (F.abs(F.col("pred_var") - F.col("v")) < 1e-9)).alias("same"))


@query("joint_deep_kernel")
def _(spark, d):
    """The bound of a deep kernel on all parts, from two stages (step 0) on through joint steps."""
    study = part_study(spark, d)
    rows = storage.materialize(nested.scaled(study, nested.FAMILIES["VDKL"], 1).select(*study.key, "features", "t"), "parts")
    fitted = net.pretrain_extractor(rows, len(study.features), 16, 3, 2, epochs=3, target="t")
    edges = scale.array_bounds(fitted.transform(rows, ["t"]), "features").collect()[0]
    extractor, params = joint.extractor_of(fitted, np.array(edges.lo), np.array(edges.hi))
    inside = storage.materialize(joint._features(rows, extractor, params, [*study.key, "t"], "features"), "learned")
    kernels = gp.candidate_kernels("rbf", gp.feature_spread(inside))
    start = gp.fit(inside, gp.random_points(inside, study.key, 20), kernels, gp.fit_mean(inside, target="t"), target="t")
    _, bounds = joint.fit(rows, extractor, params, start, steps=4, target="t")
    return spark.createDataFrame(list(enumerate(bounds)), "step int, bound double")


# -- searches and nested runs -----------------------------------------------------------

SEARCH_TRIALS = 2  # configurations of a search, drawn from the whole space and run as drawn


def _forest_configs(spark, holdout=False) -> list[dict]:
    numbers = spark.range(SEARCH_TRIALS).withColumnRenamed("id", "number")
    return nested.draw_configs(space.draw_trials(numbers, "RF", 73, holdout=holdout), list(space.SPACES["RF"].params))


@query("cv_search")
def _(spark, d):
    log = nested.search(part_study(spark, d), "GRF", 1, _forest_configs(spark), holdout_above=10**12)
    return log.select("outer_cv_split", "number", "value", "metric", "state")


@query("holdout_search")
def _(spark, d):
    log = nested.search(part_study(spark, d), "GRF", 1, _forest_configs(spark, holdout=True), holdout_above=0)
    return log.select("outer_cv_split", "number", "value", "metric", "state")


@query("nested_study")
def _(spark, d):
    _, rows = nested.nested_study(part_study(spark, d), "GRF", _forest_configs(spark))
    return rows.drop("params")


@query("reevaluation")
def _(spark, d):
    study = part_study(spark, d)
    rows, _ = nested.evaluate(study, "SGP", {run: {**SPARSE_GP, "minit": "random"} for run in range(1, 6)})
    path = storage.fresh_path(spark, "results")
    results.append_log(rows, path)
    results.append_log(nested.reevaluate(study, "SGP", results.read_log(spark, path)), path)
    return results.read_log(spark, path).drop("params")


@query("full_data_run")
def _(spark, d):
    df, features = encoded_policies(spark, d, folds=False)
    return nested.full_data_run(df, ["o_orderkey"], features, "policies", "RF", {**FOREST, "n_estimators": 10, "max_depth": 5}).drop("params")
