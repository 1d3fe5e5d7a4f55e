import numpy as np

from tabsleuth.operators import metrics as mt


def test_auc_with_ties(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1), (1, 0.1), (0, 0.05)]
    df = spark.createDataFrame(rows, "y_true int, score double")
    got = mt.roc_auc(df).first()[0]
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    want = np.mean([1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg])
    assert abs(got - want) < 1e-12


def test_average_precision_stepwise(spark):
    rows = [(1, 0.8), (0, 0.7), (1, 0.6), (1, 0.6), (0, 0.2)]
    df = spark.createDataFrame(rows, "y_true int, score double")
    # thresholds .8: P=1, R=1/3; .7: P=1/2, R=1/3; .6: P=3/4, R=1; .2: P=3/5, R=1
    want = (1 / 3) * 1 + 0 * 0.5 + (2 / 3) * 0.75
    assert abs(mt.average_precision(df).first()[0] - want) < 1e-12


def test_confusion_zero_cells_and_specificity(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "y_true string, y_pred string")
    cm = {(r["actual"], r["predicted"]): r["count"] for r in mt.confusion_matrix(df).collect()}
    assert len(cm) == 9 and cm[("b", "b")] == 0 and cm[("b", "a")] == 1
    assert mt.specificity(df, positive="a").first()[0] == 0.0
    assert abs(mt.balanced_accuracy(df).first()[0] - (1 + 0 + 1) / 3) < 1e-12


def test_regression_edge_cases(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.0, -1.0)], "y_true double, y_pred double")
    r = mt.regression_metrics(df).first()
    assert r["mape"] == float("inf") and r["r2"] == 0.0
    same = spark.createDataFrame([(2.0, 2.0), (2.0, 2.0)], "y_true double, y_pred double")
    assert mt.regression_metrics(same).first()["r2"] == 1.0
    assert mt.adjusted_r2(mt.regression_metrics(same)).first()[0] == 1.0


def test_log_loss_clipping(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 0.0)], "y_true int, score double")
    assert mt.log_loss_binary(df).first()[0] < 1e-12
