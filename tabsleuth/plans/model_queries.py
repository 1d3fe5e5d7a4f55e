"""Registered queries for preparation and models (G), explainability (I)
and the remaining sources / sinks (A1, A5, A6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import explain as ex
from ..operators import metrics as mt
from ..operators import models as md
from ..operators import prep as pp
from ..session import materialize
from . import fixtures as fx
from .profile_queries import profile_sql
from .registry import finish, r, register

W = fx.with_fixtures


# ---------------------------------------------------------------- G1-G6

_STRAT = ("SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) "
          "<= ceil(0.2 * count(*) OVER (PARTITION BY o_orderstatus)) AS is_test FROM orders")


@register("stratified_split", _STRAT)
def q_stratified_split(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return finish(pp.stratified_split(o, "o_orderstatus", "o_orderkey", order_col="o_orderkey"))


@register("stratified_split_hashed")
def q_stratified_split_hashed(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return finish(pp.stratified_split(o, "o_orderstatus", "o_orderkey"))


@register("random_split")
def q_random_split(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return finish(pp.random_split(o, "o_orderkey"))


def _li_split(spark, sf_dir):
    li = fx.li_nulls(spark, sf_dir).withColumn("_ord", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    s = materialize(pp.stratified_split(li, "l_linestatus", ["l_orderkey", "l_linenumber"], order_col="_ord"))
    return s.where(~F.col("is_test")), s.where(F.col("is_test"))


_LI_SPLIT = ("li_split AS (SELECT *, row_number() OVER (PARTITION BY l_linestatus ORDER BY l_orderkey * 10 + l_linenumber) "
             "<= ceil(0.2 * count(*) OVER (PARTITION BY l_linestatus)) AS is_test FROM li_nulls)")


def _with_split(sql: str) -> str:
    return W(sql, "li_nulls").replace(") SELECT", "), " + _LI_SPLIT + " SELECT", 1)


@register("impute_median_mode", _with_split(
    "SELECT l_orderkey, l_linenumber, coalesce(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM li_split WHERE NOT is_test)) AS l_discount, "
    "coalesce(l_returnflag, (SELECT l_returnflag FROM li_split WHERE NOT is_test AND l_returnflag IS NOT NULL GROUP BY l_returnflag "
    "ORDER BY count(*) DESC, l_returnflag LIMIT 1)) AS l_returnflag FROM li_split WHERE is_test"))
def q_impute_median_mode(spark, sf_dir):
    train, test = _li_split(spark, sf_dir)
    med, mod = pp.impute_fit(train, ["l_discount"], ["l_returnflag"])
    out = pp.impute_apply(test.select("l_orderkey", "l_linenumber", "l_discount", "l_returnflag"), med, mod)
    return finish(out)


def _scaled(c: str) -> str:
    train = "FROM li_split WHERE NOT is_test"
    return r(f"({c} - (SELECT avg({c}) {train})) / (SELECT stddev_pop({c}) {train})", 5) + f" AS {c}_scaled"


@register("standard_scale", _with_split(f"SELECT l_orderkey, l_linenumber, {', '.join(_scaled(c) for c in fx.LINEITEM_NUMERIC)} FROM li_split WHERE is_test"))
def q_standard_scale(spark, sf_dir):
    train, test = _li_split(spark, sf_dir)
    names = fx.LINEITEM_NUMERIC
    means, stds = pp.scale_fit(train, names)
    scaled = pp.scale_apply(test.select("l_orderkey", "l_linenumber", *[F.col(c).cast("double").alias(f"{c}_scaled") for c in names]), {f"{c}_scaled": means[c] for c in names}, {f"{c}_scaled": stds[c] for c in names})
    return finish(scaled, digits=5)


def _topk_level_sql(c: str) -> str:
    kept = (f"(SELECT {c} FROM (SELECT {c}, count(*) AS n FROM part WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, {c} "
            f"LIMIT CASE WHEN (SELECT count(DISTINCT {c}) FROM part) > 20 THEN 19 ELSE 20 END))")
    infreq = f"(SELECT count(DISTINCT {c}) FROM part) > 20"
    return f"CASE WHEN {c} IN {kept} THEN {c} WHEN {c} IS NOT NULL AND {infreq} THEN 'infrequent' END"


@register("one_hot_topk", "SELECT p_partkey, " + _topk_level_sql("p_type") + " AS p_type, " + _topk_level_sql("p_brand") + " AS p_brand, "
          + _topk_level_sql("p_name") + " AS p_name FROM part")
def q_one_hot_topk(spark, sf_dir):
    p = fx.table(spark, sf_dir, "part")
    levels, infreq = pp.one_hot_fit(p, ["p_type", "p_brand", "p_name"])
    return finish(p.select("p_partkey", *[pp.one_hot_level(p, c, levels[c], infreq[c]).alias(c) for c in ["p_type", "p_brand", "p_name"]]))


def _preprocess_sql() -> str:
    """Median / mode of the training rows, then scaling and indicator columns."""
    train = "FROM li_split WHERE NOT is_test"
    out = ["l_orderkey", "l_linenumber"]
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"):
        x = f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) {train}))"
        out.append(r(f"({x} - (SELECT avg({x}) {train})) / (SELECT stddev_pop({x}) {train})", 5) + f" AS {c}")
    mode = f"(SELECT l_returnflag {train} AND l_returnflag IS NOT NULL GROUP BY l_returnflag ORDER BY count(*) DESC, l_returnflag LIMIT 1)"
    out += [f"CASE WHEN coalesce(l_returnflag, {mode}) = '{v}' THEN 1.0 ELSE 0.0 END::DOUBLE AS \"l_returnflag={v}\"" for v in "ANR"]
    return f"SELECT {', '.join(out)} FROM li_split WHERE is_test"


@register("preprocess", _with_split(_preprocess_sql()))
def q_preprocess(spark, sf_dir):
    train, test = _li_split(spark, sf_dir)
    feats = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"]
    prep = pp.preprocess_fit(train, feats)
    return finish(pp.preprocess_apply(test, prep, keep=["l_orderkey", "l_linenumber"], vector=None), digits=5)


# ---------------------------------------------------------------- G7-G18 models

ORDER_FEATURES = ["o_totalprice", "o_custkey", "o_orderpriority"]


def _one_model(spark, sf_dir, name: str, task: str):
    o = fx.table(spark, sf_dir, "orders")
    if task == "classification":
        return md.train_baselines(o, "o_orderstatus", "o_orderkey", "classification", ORDER_FEATURES, models=[name], cv_folds=0).results
    feats = ["o_custkey", "o_orderstatus", "o_orderpriority"]
    return md.train_baselines(o, "o_totalprice", "o_orderkey", "regression", feats, models=[name], cv_folds=0).results


for _key, _name, _task in [
    ("fit_logistic", "Logistic Regression", "classification"),
    ("fit_tree_clf", "Decision Tree", "classification"),
    ("fit_forest_clf", "Random Forest", "classification"),
    ("fit_naive_bayes", "Naive Bayes", "classification"),
    ("knn_predict", "K-Nearest Neighbors", "classification"),
    ("knn_regression", "K-Nearest Neighbors", "regression"),
    ("fit_linear", "Linear Regression", "regression"),
    ("fit_ridge", "Ridge Regression", "regression"),
    ("fit_lasso", "Lasso Regression", "regression"),
    ("fit_tree_reg", "Decision Tree", "regression"),
    ("fit_forest_reg", "Random Forest", "regression"),
]:
    register(_key)(lambda spark, sf_dir, _n=_name, _t=_task: finish(_one_model(spark, sf_dir, _n, _t).where(F.col("metric") != "train_seconds")))


def _one_feature_fit(spark, sf_dir, name: str):
    """The library's own estimator, fitted to one feature."""
    from pyspark.ml.feature import VectorAssembler

    li = fx.table(spark, sf_dir, "lineitem")
    d = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(li.select("l_quantity", F.col("l_extendedprice").alias("label")))
    n, y_std = d.agg(F.count(F.lit(1)), F.stddev_samp("label")).first()
    m = md.regressors(n, y_std)[name].fit(d)
    return spark.createDataFrame([(float(m.intercept), float(m.coefficients[0]))], "intercept double, slope double")


_XY = "l_extendedprice, l_quantity"


@register("fit_linear_one_feature", f"SELECT {r(f'regr_intercept({_XY})')} AS intercept, {r(f'regr_slope({_XY})')} AS slope FROM lineitem")
def q_fit_linear_one_feature(spark, sf_dir):
    return finish(_one_feature_fit(spark, sf_dir, "Linear Regression"))


@register("fit_ridge_one_feature",
          f"SELECT {r(f'avg(l_extendedprice) - regr_sxy({_XY}) / (regr_sxx({_XY}) + 1.0) * avg(l_quantity)')} AS intercept, "
          f"{r(f'regr_sxy({_XY}) / (regr_sxx({_XY}) + 1.0)')} AS slope FROM lineitem")
def q_fit_ridge_one_feature(spark, sf_dir):
    return finish(_one_feature_fit(spark, sf_dir, "Ridge Regression"))


@register("fit_lasso_one_feature",
          f"SELECT {r('ay - s * ax', 4)} AS intercept, {r('s', 4)} AS slope FROM "
          f"(SELECT avg(l_extendedprice) AS ay, avg(l_quantity) AS ax, sign(regr_sxy({_XY})) * greatest(abs(regr_sxy({_XY})) / count(*) - 0.1, 0) "
          f"/ (regr_sxx({_XY}) / count(*)) AS s FROM lineitem)")
def q_fit_lasso_one_feature(spark, sf_dir):
    return finish(_one_feature_fit(spark, sf_dir, "Lasso Regression"), digits=4)


_NB_FLOOR = "(SELECT 1e-9 * greatest(var_pop(o_totalprice), var_pop(o_custkey)) FROM orders)"  # MLlib's smoothing of variances


@register("naive_bayes_class_stats",
          "SELECT o_orderstatus AS class, " + r("ln(count(*) / (SELECT count(*) FROM orders))") + " AS log_prior, " + r("avg(o_totalprice)", 4) + " AS mean_totalprice, "
          + r(f"var_pop(o_totalprice) + {_NB_FLOOR}", 0) + " AS var_totalprice, " + r("avg(o_custkey)", 4) + " AS mean_custkey, "
          + r(f"var_pop(o_custkey) + {_NB_FLOOR}", 2) + " AS var_custkey FROM orders GROUP BY o_orderstatus")
def q_naive_bayes_class_stats(spark, sf_dir):
    """What the fitted naive Bayes baseline has learnt."""
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    o = fx.table(spark, sf_dir, "orders")
    index = StringIndexer(inputCol="o_orderstatus", outputCol="label", stringOrderType="alphabetAsc").fit(o)
    d = VectorAssembler(inputCols=["o_totalprice", "o_custkey"], outputCol="features").transform(index.transform(o))
    m = md.classifiers(o.count(), 3)["Naive Bayes"].fit(d)
    theta, sigma = m.theta.toArray(), m.sigma.toArray()
    rows = [(c, float(m.pi[i]), float(theta[i][0]), float(sigma[i][0]), float(theta[i][1]), float(sigma[i][1])) for i, c in enumerate(index.labels)]
    out = spark.createDataFrame(rows, "class string, log_prior double, mean_totalprice double, var_totalprice double, mean_custkey double, var_custkey double")
    return finish(out, per_column={"mean_totalprice": 4, "mean_custkey": 4, "var_custkey": 2, "var_totalprice": 0})


@register("knn_embeddings", "SELECT q AS vec_id, arg_min(y, (-v, y)) AS prediction FROM (SELECT q, y, count(*) AS v FROM ("
          "SELECT a.vec_id AS q, b.label::DOUBLE AS y, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS k "
          "FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND b.vec_id % 20 <> 0) WHERE k <= 5 GROUP BY q, y) GROUP BY q")
def q_knn_embeddings(spark, sf_dir):
    """Queries: every vector whose id is divisible by 20, against all others."""
    from pyspark.ml.functions import array_to_vector

    e = fx.table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), F.col("label").cast("double").alias("label"))
    asked = F.col("vec_id") % 20 == 0
    return finish(md.knn_predict(e.where(~asked), e.where(asked), "vec_id"))


_FOLDS = ("SELECT o_orderkey, o_orderstatus, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM orders")


@register("fold_assignment", _FOLDS)
def q_fold_assignment(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return finish(pp.assign_folds(o, "o_orderkey", "o_orderstatus", order_col="o_orderkey"))


@register("cross_validate")
def q_cross_validate(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    run = md.train_baselines(o, "o_orderstatus", "o_orderkey", "classification", ORDER_FEATURES)
    return finish(run.results.where(F.col("metric") == "cv_mean"))


@register("train_baselines")
def q_train_baselines(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    run = md.train_baselines(o, "o_orderstatus", "o_orderkey", "classification", ORDER_FEATURES)
    return finish(run.results.where(F.col("metric") != "train_seconds"))


@register("explain_best_baseline")
def q_explain_best_baseline(spark, sf_dir):
    """Permutation importance of the best fitted baseline, by its test score."""
    o = fx.table(spark, sf_dir, "orders")
    run = md.train_baselines(o, "o_orderstatus", "o_orderkey", "classification", ORDER_FEATURES, cv_folds=0)
    return finish(ex.explain_baseline(run, ORDER_FEATURES, "o_orderkey"))


_CVS = ("SELECT run, model, metric, avg(value) AS cv_mean FROM cv_scores GROUP BY run, model, metric")


def _cv_summary(spark, sf_dir):
    s = mt.cv_score_summary(fx.cv_scores(spark, sf_dir))
    return s.select("run", "model", F.lit("primary_score").alias("metric"), F.col("cv_mean").alias("value"), F.lit(None).cast("string").alias("error"))


@register("select_best_model", W(
    f"SELECT run, arg_max(model, cv_mean) AS best_model, {r('max(cv_mean)')} AS best_score FROM ({_CVS}) GROUP BY run", "cv_scores"))
def q_select_best_model(spark, sf_dir):
    return finish(md.select_best_model(_cv_summary(spark, sf_dir), ["run"]))


@register("model_leaderboard", W(
    f"SELECT run, CAST(row_number() OVER (PARTITION BY run ORDER BY cv_mean DESC, model) AS INTEGER) AS rank, model, {r('cv_mean')} AS primary_metric, "
    f"'Success' AS status, NULL::VARCHAR AS error FROM ({_CVS})", "cv_scores"))
def q_model_leaderboard(spark, sf_dir):
    return finish(md.model_leaderboard(_cv_summary(spark, sf_dir), "primary_score", ["run"]))


# ---------------------------------------------------------------- I1-I8

def _rule_predict(df):
    return df.withColumn("y_pred", (F.col("o_totalprice") > 250000).cast("int")).withColumn("y_true", (F.col("o_orderstatus") == "F").cast("int"))


def _accuracy(df, by):
    return mt.accuracy(df, by=by)


@register("permutation_importance_shift",
          "WITH b AS (SELECT o_orderstatus, o_totalprice, coalesce(lead(o_totalprice) OVER (ORDER BY o_orderkey), "
          "first_value(o_totalprice) OVER (ORDER BY o_orderkey)) AS tp_next FROM orders) "
          "SELECT 'o_totalprice' AS feature, " + r("avg(CASE WHEN (o_totalprice > 250000) = (o_orderstatus = 'F') THEN 1.0 ELSE 0.0 END) "
                                                   "- avg(CASE WHEN (tp_next > 250000) = (o_orderstatus = 'F') THEN 1.0 ELSE 0.0 END)")
          + " AS importance_mean, 0.0 AS importance_std FROM b UNION ALL SELECT 'o_custkey', 0.0, 0.0")
def q_permutation_importance_shift(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    return finish(ex.permutation_importance(o, ["o_totalprice", "o_custkey"], _rule_predict, _accuracy, "o_orderkey", method="shift"))


@register("permutation_importance")
def q_permutation_importance(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    return finish(ex.permutation_importance(o, ["o_totalprice", "o_custkey"], _rule_predict, _accuracy, "o_orderkey", repeats=5))


def _explained_tree(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    feats = ["o_custkey", "o_orderstatus", "o_orderpriority"]
    prep = pp.preprocess_fit(o, feats)
    data = materialize(pp.preprocess_apply(o.withColumn("label", F.col("o_totalprice")), prep, keep=["o_orderkey", "label"]))
    model = md.regressors(data.count(), 1.0)["Decision Tree"].fit(data)
    return model, data, ex.tree_shap(model, data, ["o_orderkey"], prep.feature_names(), kind="regression")


@register("tree_shap")
def q_tree_shap(spark, sf_dir):
    return finish(_explained_tree(spark, sf_dir)[2])


@register("tree_shap_additivity", "SELECT count(*) AS n_rows, 0.0 AS largest_gap FROM orders")
def q_tree_shap_additivity(spark, sf_dir):
    """Contributions and base value of every row sum to its prediction."""
    model, data, shap = _explained_tree(spark, sf_dir)
    sums = shap.groupBy("o_orderkey").agg(F.sum("value").alias("s")).join(model.transform(data).select("o_orderkey", "prediction"), "o_orderkey")
    return finish(sums.agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.abs(F.col("s") - F.col("prediction"))).alias("largest_gap")), digits=4)


@register("shap_importance", W(f"SELECT feature, {r('avg(abs(value))')} AS importance FROM contributions GROUP BY feature", "contributions"))
def q_shap_importance(spark, sf_dir):
    return finish(ex.shap_importance(fx.contributions(spark, sf_dir)))


@register("top_features", W(
    "SELECT run, rank, feature, importance, n_positive FROM (SELECT run, CAST(row_number() OVER (PARTITION BY run ORDER BY importance DESC, feature) AS INTEGER) AS rank, "
    f"feature, {r('importance')} AS importance, count(*) FILTER (WHERE importance > 0) OVER (PARTITION BY run) AS n_positive FROM importances) WHERE rank <= 5",
    "importances"))
def q_top_features(spark, sf_dir):
    return finish(ex.top_features(fx.importances(spark, sf_dir), 5))


_TILTED = "SELECT run, feature, CASE feature WHEN 'l_tax' THEN -importance WHEN 'l_quantity' THEN importance + 0.2 ELSE importance END AS importance FROM importances"


@register("weak_and_dominant_features", W(
    f"SELECT run, feature, 'weak' AS kind FROM ({_TILTED}) WHERE importance <= 0 UNION ALL "
    f"SELECT run, arg_max(feature, importance) AS feature, 'dominant' FROM ({_TILTED}) GROUP BY run HAVING max(importance) > 0.1", "importances"))
def q_weak_and_dominant_features(spark, sf_dir):
    imp = F.col("importance")
    tilted = F.when(F.col("feature") == "l_tax", -imp).when(F.col("feature") == "l_quantity", imp + 0.2).otherwise(imp)
    return finish(ex.weak_and_dominant_features(fx.importances(spark, sf_dir).withColumn("importance", tilted)))


@register("importance_stats", W(
    "SELECT run, " + ", ".join(f"{r(e)} AS {a}" for e, a in [("avg(importance)", "mean_importance"), ("stddev_pop(importance)", "std_importance"),
                                                             ("max(importance)", "max_importance"), ("min(importance)", "min_importance")])
    + ", count(*) FILTER (WHERE importance = 0) AS zero_importance_count, " + r("count(*) FILTER (WHERE importance = 0) / count(*)") + " AS zero_importance_ratio, "
    + ", ".join(f"{r(f'quantile_cont(importance, {q})')} AS {a}" for q, a in [(0.25, "q25"), (0.5, "q50"), (0.75, "q75")])
    + ", array_to_string(list(feature ORDER BY importance DESC, feature)[1:5], ',') AS top_5_features, "
    "array_to_string(list(feature ORDER BY importance DESC, feature)[1:10], ',') AS top_10_features, "
    "list(round(importance, 6) ORDER BY importance DESC, feature)[1:5] AS top_5_scores, list(round(importance, 6) ORDER BY importance DESC, feature)[1:10] AS top_10_scores "
    "FROM importances GROUP BY run", "importances"))
def q_importance_stats(spark, sf_dir):
    return finish(ex.importance_stats(fx.importances(spark, sf_dir)))


# One run of the fixture scores, with a failed model beside it.
_RUN = f"(SELECT model, cv_mean FROM ({_CVS}) WHERE run = (SELECT min(run) FROM cv_scores))"
_MODELING = (
    f"SELECT 'modeling' AS section, 'best_model' AS item, (SELECT arg_min(model, (-cv_mean, model)) FROM {_RUN}) AS value "
    f"UNION ALL SELECT 'modeling', 'best_score', printf('%.4f', (SELECT max(cv_mean) FROM {_RUN})) "
    f"UNION ALL SELECT 'modeling', 'performance_level', (SELECT CASE WHEN max(cv_mean) > 0.9 THEN 'excellent' WHEN max(cv_mean) > 0.8 THEN 'good' "
    f"WHEN max(cv_mean) > 0.6 THEN 'moderate' ELSE 'poor' END FROM {_RUN}) "
    f"UNION ALL SELECT 'modeling', 'models_trained', (SELECT CAST(count(*) AS VARCHAR) FROM {_RUN}) UNION ALL SELECT 'modeling', 'models_failed', '1' "
    "UNION ALL SELECT 'top_features', feature, printf('%.4f', importance) FROM (SELECT feature, avg(importance) AS importance FROM importances GROUP BY feature ORDER BY importance DESC, feature LIMIT 5)"
)


def _one_run(spark, sf_dir):
    """(results of one run with a failed model, mean importances)."""
    scores = _cv_summary(spark, sf_dir)
    first = scores.agg(F.min("run")).first()[0]
    results = scores.where(F.col("run") == first).select("model", "metric", "value", "error")
    failed = spark.createDataFrame([("Broken Model", "error", None, "did not fit")], "model string, metric string, value double, error string")
    return results.unionByName(failed), fx.importances(spark, sf_dir).groupBy("feature").agg(F.avg("importance").alias("importance"))


def _findings_sql() -> str:
    prof = f"({profile_sql('cust_const')})"
    return (
        "SELECT 'dataset' AS section, 'rows' AS item, CAST(count(*) AS VARCHAR) AS value FROM cust_const "
        "UNION ALL SELECT 'dataset', 'columns', '8' "
        f"UNION ALL SELECT 'dataset', 'missing_percentage', printf('%.2f', 100.0 * sum(missing_count) / sum(n_rows)) FROM {prof} "
        f"UNION ALL SELECT 'high_missing', \"column\", printf('%.2f', missing_pct) FROM {prof} WHERE missing_pct > 30 "
        f"UNION ALL SELECT 'constant', \"column\", CAST(unique_count AS VARCHAR) FROM {prof} WHERE is_constant "
        f"UNION ALL SELECT 'high_cardinality', \"column\", CAST(unique_count AS VARCHAR) FROM {prof} WHERE family = 'string' AND unique_count > 50 AND NOT is_constant "
        "UNION ALL SELECT 'relationships', 'strong_correlations', CAST(count(*) AS VARCHAR) FROM ("
        + " UNION ALL ".join(f"SELECT corr({a}, {b}) AS c FROM cust_const" for a, b in _num_pairs()) + ") WHERE abs(c) >= 0.7 AND NOT isnan(c) "
        "UNION ALL SELECT 'relationships', 'multicollinear_columns', '2' WHERE (SELECT count_if(c_acctbal <> c_acctbal_copy) FROM cust_const) = 0 "
        f"UNION ALL SELECT * FROM ({_MODELING})"
    )


def _num_pairs():
    nums = ["c_custkey", "c_nationkey", "c_acctbal", "c_acctbal_copy", "c_zero"]
    return [(a, b) for i, a in enumerate(nums) for b in nums[i + 1:]]


@register("dataset_findings", W(_findings_sql(), "cust_const", "cv_scores", "importances"))
def q_dataset_findings(spark, sf_dir):
    results, importances = _one_run(spark, sf_dir)
    return ex.dataset_findings(fx.cust_const(spark, sf_dir), results=results, task="classification", importances=importances)


@register("performance_level", W(
    "SELECT run, model, metric, " + r("cv_mean") + " AS value, CASE WHEN cv_mean > 0.9 THEN 'excellent' WHEN cv_mean > 0.8 THEN 'good' "
    "WHEN cv_mean > 0.6 THEN 'moderate' ELSE 'poor' END AS performance_level FROM (" + _CVS + ")", "cv_scores"))
def q_performance_level(spark, sf_dir):
    s = mt.cv_score_summary(fx.cv_scores(spark, sf_dir)).select("run", "model", "metric", F.col("cv_mean").alias("value"))
    return finish(ex.performance_level(s, "classification"))


# ---------------------------------------------------------------- A1, A5, A6

@register("read_csv_sniff", "SELECT * FROM nation")
def q_read_csv_sniff(spark, sf_dir):
    from ..session import scratch_path
    from ..sources import io

    path = scratch_path(spark, "nation-csv")
    fx.table(spark, sf_dir, "nation").coalesce(1).write.mode("overwrite").option("sep", ";").csv(path, header=True)
    return finish(io.read_csv_sniff(spark, path))


@register("summary_csv_sink", W(
    "SELECT * FROM (VALUES ('Total Rows', CAST((SELECT count(*) FROM li_nulls) AS VARCHAR)), ('Total Columns', '11'), "
    "('Missing Values (%)', printf('%.2f', (SELECT 100.0 * (" + " + ".join(f"count(*) - count({c})" for c in fx.LINEITEM_COLS)
    + ") / (count(*) * 11) FROM li_nulls))), ('Numeric Columns', '8'), ('Categorical Columns', '2')) t(metric, value)", "li_nulls"))
def q_summary_csv_sink(spark, sf_dir):
    from ..session import scratch_path
    from ..sources import io

    path = scratch_path(spark, "summary-csv")
    io.write_summary_csv(fx.li_nulls(spark, sf_dir), path)
    return spark.read.csv(path, header=True, inferSchema=False)


_JSON = (
    "WITH f AS (" + _findings_sql() + ") SELECT 'cust_const' AS dataset, CAST((SELECT count(*) FROM cust_const) AS BIGINT) AS total_rows, CAST(8 AS BIGINT) AS total_cols, "
    "'c_mktsegment' AS target_column, 'classification' AS task_type, 0.0 AS missing_data_pct, "
    "(SELECT value FROM f WHERE item = 'best_model') AS best_model, CAST((SELECT value FROM f WHERE item = 'models_trained') AS BIGINT) AS models_trained, CAST(1 AS BIGINT) AS models_failed, "
    "(SELECT list(item ORDER BY CAST(value AS DOUBLE) DESC, item) FROM f WHERE section = 'top_features') AS top_features, "
    "(SELECT list(DISTINCT section ORDER BY section) FROM f WHERE section IN ('high_missing', 'constant', 'high_cardinality', 'relationships')) AS sections, "
    "CAST((SELECT count(*) FROM f WHERE section IN ('high_missing', 'constant', 'high_cardinality', 'relationships')) AS BIGINT) AS total_recommendations"
)


@register("summary_json_sink", W(_JSON, "cust_const", "cv_scores", "importances").replace(") WITH f AS", "), f AS", 1))
def q_summary_json_sink(spark, sf_dir):
    from ..session import scratch_path
    from ..sources import io

    results, importances = _one_run(spark, sf_dir)
    summary = ex.run_summary(fx.cust_const(spark, sf_dir), "c_mktsegment", "classification", results, importances, "cust_const")
    path = scratch_path(spark, "summary-json")
    io.write_summary_json(summary, path)
    back = spark.read.schema(summary.schema).json(path)
    return back.select("metadata.*", "data_quality.missing_data_pct", "modeling.*", "feature_importance.top_features", "recommendations.*")
