"""Cases that the test tables are too clean or too small to reach."""

import math
import os
import subprocess
import sys

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabsleuth.operators import clean, explain, metrics, models, prep, profile, relations
from tabsleuth.operators import distributions as ds
from tabsleuth.sources import io

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_long_keys_beyond_double_precision_stay_distinct(spark):
    df = spark.range(2**53, 2**53 + 1000).toDF("id")
    row = profile.column_profile(df).first()
    assert row["unique_count"] == 1000 and row["is_id_like"]
    top = ds.value_counts_topk(profile.frequency_table(df.limit(3)), k=5, max_unique=None).collect()
    assert sorted(int(r["value"]) for r in top) == [2**53, 2**53 + 1, 2**53 + 2]


def test_profile_of_an_empty_table_has_a_row_per_column(spark):
    rows = profile.column_profile(spark.createDataFrame([], "a int, b string, c timestamp")).orderBy("pos").collect()
    assert [(r["column"], r["n_rows"], r["unique_count"], r["missing_pct"]) for r in rows] == [("a", 0, 0, None), ("b", 0, 0, None), ("c", 0, 0, None)]


def test_profile_plan_shuffles_no_text(spark):
    df = spark.createDataFrame([("x" * 50, "2024-01-02")], "long_text string, d string")
    plan = profile.column_profile(df)._jdf.queryExecution().executedPlan().toString()
    keys = [line for line in plan.split("\n") if "hashpartitioning(pos" in line and "digest" in line]
    assert keys and all("str#" not in line for line in keys)
    assert {r["column"]: r["semantic_type"] for r in profile.column_profile(df).collect()}["d"] == "datetime"


def test_names_with_a_dot(spark):
    df = spark.createDataFrame([(1, 1.0, "v1.2"), (2, None, "v2"), (3, 3.0, None), (4, 4.0, "v1.2")], "k int, `a.b` double, `c.d` string")
    assert {r["column"]: r["missing_count"] for r in profile.column_profile(df).collect()} == {"k": 0, "a.b": 1, "c.d": 1}
    p = prep.preprocess_fit(df, ["a.b", "c.d"])
    assert p.feature_names() == ["a.b", "c.d=v1.2", "c.d=v2"]
    wide = prep.preprocess_apply(df, p, keep=["k"], vector=None)
    assert wide.columns == ["k", "a.b", "c.d=v1.2", "c.d=v2"]
    assert [list(r)[2:] for r in wide.orderBy("k").collect()] == [[1, 0], [0, 1], [1, 0], [1, 0]]
    assert prep.preprocess_apply(df, p, keep=["k"]).first()["features"].size == 3


def test_median_between_two_integers(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "x int")
    assert sorted(r["x"] for r in clean.fill_median_mode(df).collect()) == [1, 2, 2.5, 3, 4]
    med, mod = prep.impute_fit(df, ["x"], [])
    assert sorted(r["x"] for r in prep.impute_apply(df, med, mod).collect()) == [1, 2, 2.5, 3, 4]


def test_only_collinear_columns_have_an_infinite_vif(spark):
    df = spark.range(50).selectExpr("double(id % 7) AS x", "double(id % 7) AS copy", "double(id % 5 + 1) AS z", "double(id * id % 11) AS w")
    got = {r["feature"]: r["vif"] for r in relations.vif(df).collect()}
    alone = {r["feature"]: r["vif"] for r in relations.vif(df.drop("copy")).collect()}
    assert math.isinf(got["x"]) and math.isinf(got["copy"])
    assert abs(got["z"] - alone["z"]) < 1e-9 and abs(got["w"] - alone["w"]) < 1e-9


def test_latin1_files_and_caps(spark, tmp_path):
    path = tmp_path / "names.csv"
    path.write_bytes("name;city;n\nAnna;Rom;1\nJosé;München;2\n".encode("latin-1"))
    got = [tuple(r) for r in io.read_csv_sniff(spark, str(path)).collect()]
    assert got == [("Anna", "Rom", 1), ("José", "München", 2)]
    path.write_text("name;city;n\nJosé;München;2\n", encoding="utf-8")
    assert io.sniff_csv(spark, str(path)) == io.CsvShape("utf-8", ";", False)
    assert io.read_csv_sniff(spark, str(path), schema="a string, b string, c double").first()["c"] == 2.0
    assert io.row_cap(spark.range(500), 10).count() == 10 and io.row_cap(spark.range(60000)).count() == 60000


def test_importances_without_groups_and_with_ties(spark):
    imp = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", -0.1)], "feature string, importance double")
    assert [r["feature"] for r in explain.top_features(imp, 2, []).orderBy("rank").collect()] == ["a", "b"]
    assert explain.importance_stats(imp, []).first()["top_5_scores"] == [0.5, 0.5, -0.1]
    kinds = {(r["feature"], r["kind"]) for r in explain.weak_and_dominant_features(imp, []).collect()}
    assert kinds == {("c", "weak"), ("a", "dominant")}


def test_best_model_ties_and_failures(spark):
    rows = [("B", "primary_score", -3.0, None), ("A", "primary_score", -3.0, None), ("C", "error", None, "boom"), ("D", "rmse", 2.0, None), ("A", "rmse", 3.0, None)]
    res = spark.createDataFrame(rows, "model string, metric string, value double, error string")
    assert models.select_best_model(res).first()["best_model"] == "A"
    board = [(r["model"], r["primary_metric"], r["status"]) for r in models.model_leaderboard(res, "rmse").orderBy("rank").collect()]
    assert board == [("D", 2.0, "Success"), ("A", 3.0, "Success"), ("B", None, "Success"), ("C", None, "Failed")]


def test_knn_with_composite_and_text_keys(spark):
    train = spark.createDataFrame([(i // 2, i % 2, Vectors.dense([float(i)]), float(i >= 5)) for i in range(10)], ["a", "b", "features", "label"])
    test = spark.createDataFrame([(0, 0, Vectors.dense([0.2])), (0, 1, Vectors.dense([9.1]))], ["a", "b", "features"])
    got = {(r["a"], r["b"]): r["prediction"] for r in models.knn_predict(train, test, ["a", "b"], k=3).collect()}
    assert got == {(0, 0): 0.0, (0, 1): 1.0}
    text = lambda d: d.withColumn("k", F.concat_ws("-", "a", "b")).drop("a", "b")
    assert {r["k"]: r["prediction"] for r in models.knn_predict(text(train), text(test), "k", k=3).collect()} == {"0-0": 0.0, "0-1": 1.0}


def test_training_keeps_models_and_reports_failures(spark):
    df = spark.range(120).selectExpr("id AS a", "id % 3 AS b", "double(id % 10) AS x", "IF(id % 10 > 4, 'hi', 'lo') AS y")
    run = models.train_baselines(df, "y", ["a", "b"], "classification", ["x"], models=["Decision Tree", models.KNN], cv_folds=2)
    got = {(r["model"], r["metric"]): r["value"] for r in run.results.collect()}
    assert got[("Decision Tree", "accuracy")] == 1.0 and got[(models.KNN, "accuracy")] == 1.0
    assert got[("Decision Tree", "cv_mean")] == 1.0 and got[(models.KNN, "cv_mean")] == 1.0 and got[(models.KNN, "train_seconds")] >= 0
    assert set(run.models) == {"Decision Tree", models.KNN} and run.best() == "Decision Tree"
    imp = explain.explain_baseline(run, ["x"], ["a", "b"], repeats=1).first()
    assert imp["importance_mean"] > 0.2
    value, error = models.cross_validate_score(df.withColumn("label", F.lit(1.0)).withColumn("fold", F.lit(0)), None, "classification", ["x"], ["a"])
    assert value is None and error


def test_three_classes_have_probability_metrics(spark):
    df = spark.range(150).selectExpr("id AS a", "double(id % 30) AS x", "CASE WHEN id % 30 < 10 THEN 'p' WHEN id % 30 < 20 THEN 'q' ELSE 'r' END AS y")
    run = models.train_baselines(df, "y", "a", "classification", ["x"], models=["Decision Tree"], cv_folds=0)
    got = {r["metric"]: r["value"] for r in run.results.collect()}
    assert got["roc_auc_ovr"] == 1.0 and got["log_loss"] < 1e-6


def test_many_labels_have_a_sparse_confusion_matrix(spark):
    df = spark.range(20000).selectExpr("id AS y_true", "id AS y_pred")
    assert metrics.confusion_matrix(df, zeros=False).count() == 20000


def test_worker_code_is_shipped(tmp_path):
    code = (
        f"import sys; sys.path.insert(0, {REPO!r}); import __spark_entry__ as e; from tabsleuth.session import local_session\n"
        "s = local_session(2); q = e.queries()\n"
        "print('ROWS', [len(q[k](s, '/root/testdata/sf0.001').collect()) for k in ('chi_square_pvalues', 'anova_pvalues', 'knn_embeddings')])"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS [3, 6, 25]" in out.stdout, out.stderr[-2000:]


def test_scratch_folder_must_be_shared_on_a_cluster(spark):
    from tabsleuth import session

    class Context:
        master = "yarn"

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})()

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())
