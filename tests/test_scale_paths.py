"""Groups of any size and with NULL keys: splits, folds and rank correlations."""

import numpy as np
from pyspark.sql import functions as F

from tabsleuth.operators import explain, metrics, prep, relations as rl

from conftest import SF001


def _ranks(x):
    order = np.argsort(x, kind="stable")
    r = np.empty(len(x))
    r[order] = np.arange(1, len(x) + 1)
    for v in np.unique(x):
        r[x == v] = r[x == v].mean()
    return r


def test_spearman_and_kendall_with_missing_values_equal_plain_ones(spark):
    rng = np.random.default_rng(4)
    a = rng.integers(0, 40, 300).astype(float)
    b = a + rng.normal(size=300)
    c = rng.normal(size=300)
    c[::9] = np.nan
    d = rng.integers(0, 2, 300).astype(float)
    cols = dict(a=a, b=b, c=c, d=d)
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in zip(*cols.values())], "a double, b double, c double, d double")
    spear = {(r["var1"], r["var2"]): r["value"] for r in rl.spearman(df, batch=2).collect()}
    kend = {(r["var1"], r["var2"]): r["value"] for r in rl.kendall_matrix(df).collect()}
    assert spear.keys() == kend.keys() and len(spear) == 6
    for (p, q), value in spear.items():
        ok = ~np.isnan(cols[p]) & ~np.isnan(cols[q])
        x, y = cols[p][ok], cols[q][ok]
        assert abs(value - np.corrcoef(_ranks(x), _ranks(y))[0, 1]) < 1e-12
        sx, sy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
        assert abs(kend[(p, q)] - (sx * sy).sum() / np.sqrt((sx != 0).sum() * (sy != 0).sum())) < 1e-12


def test_split_and_folds_keep_rows_with_null_labels(spark):
    df = spark.range(40).selectExpr("id", "CASE WHEN id % 4 = 0 THEN NULL ELSE id % 2 END AS label")
    split = prep.stratified_split(df, "label", "id").groupBy("label").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()
    assert sorted((str(r["label"]), r["n"], r["t"]) for r in split) == [("0", 10, 2), ("1", 20, 4), ("None", 10, 2)]
    folds = prep.assign_folds(df, "id", "label").groupBy("label", "fold").count().collect()
    assert len(folds) == 15 and sum(r["count"] for r in folds) == 40


def test_ties_and_repeated_keys_give_one_result(spark):
    df = spark.createDataFrame([(1, float(i % 3), i) for i in range(30)], "k int, x double, y int")
    one, two = (sorted(map(tuple, prep.rank_within(f, None, F.col("k")).collect())) for f in (df, df.orderBy(F.desc("y")).repartition(5)))
    assert one == two


def test_no_task_gets_all_rows_of_one_key(spark):
    li = spark.read.parquet(f"{SF001}/orders.parquet").selectExpr("o_orderkey", "o_totalprice / 600000 AS score", "o_orderstatus = 'F' AS y_true", "o_orderstatus")
    plans = [metrics.roc_curve(li, positive=True), metrics.roc_auc(li, positive=True), metrics.average_precision(li, positive=True), prep.stratified_split(li, "o_orderstatus", "o_orderkey"), explain.permute_column(li, "score", "o_orderkey")]
    for df in plans:
        lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
        for line, below in zip(lines, lines[1:]):
            if "hashpartitioning(g#" in line or "hashpartitioning(_grp#" in line:
                assert "partial_" in below  # sums of a task, not rows
