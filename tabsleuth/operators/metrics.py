"""Evaluation metrics over a prediction table.

Input is a DataFrame with ``y_true``, ``y_pred`` and, where needed, a score
(binary) or one probability column per class. Every metric is one
aggregation (plus, for curves and AUC, the two-level prefix sum over the
distinct scores); class-level tables are small (classes x classes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import cumulative_by_value
from ..functions.stats import normal_quantile
from ..session import materialize

EPS = 2.220446049250313e-16  # float64 machine epsilon (probability clipping)


def _eq(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


# ---------------------------------------------------------------- H1-H7

def accuracy(pred: DataFrame, y: str = "y_true", p: str = "y_pred", by: str | None = None) -> DataFrame:
    """H1 (with ``by``: one row for each of its values)"""
    return pred.groupBy(*([by] if by else [])).agg(F.avg(_eq(F.col(y), F.col(p)).cast("double")).alias("accuracy"))


def labels(pred: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Sorted union of the labels seen in y_true and y_pred (one row each)."""
    return pred.select(F.col(y).alias("label")).union(pred.select(F.col(p).alias("label"))).where(F.col("label").isNotNull()).distinct()


def confusion_matrix(pred: DataFrame, y: str = "y_true", p: str = "y_pred", zeros: bool = True) -> DataFrame:
    """H2: (actual, predicted, count). With ``zeros`` the empty cells of the
    label union are rows too (classes^2 of them); without, only cells that
    occur, for any number of labels."""
    counts = pred.groupBy(F.col(y).alias("actual"), F.col(p).alias("predicted")).agg(F.count(F.lit(1)).alias("count"))
    if not zeros:
        return counts.where(F.col("actual").isNotNull() & F.col("predicted").isNotNull())
    lb = labels(pred, y, p)
    grid = lb.select(F.col("label").alias("actual")).crossJoin(lb.select(F.col("label").alias("predicted")))  # labels, not rows
    return grid.join(counts, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def per_class(pred: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """(label, tp, support, predicted, precision, recall, f1) per label of the union."""
    by_true = pred.groupBy(F.col(y).alias("label")).agg(
        F.count(F.lit(1)).alias("support"), F.count_if(_eq(F.col(y), F.col(p))).alias("tp")
    )
    by_pred = pred.groupBy(F.col(p).alias("label")).agg(F.count(F.lit(1)).alias("predicted"))
    t = labels(pred, y, p).join(by_true, "label", "left").join(by_pred, "label", "left").fillna(0, ["support", "tp", "predicted"])
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    t = t.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return t.withColumn("f1", f1)


def balanced_accuracy(pred: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """H3: mean recall over the classes present in y_true."""
    return per_class(pred, y, p).where(F.col("support") > 0).agg(F.avg("recall").alias("balanced_accuracy"))


def _binary_counts(pred: DataFrame, y: str, p: str, positive=1) -> DataFrame:
    yt, yp = F.col(y) == F.lit(positive), F.col(p) == F.lit(positive)
    return pred.agg(
        F.count_if(yt & yp).alias("tp"),
        F.count_if(~yt & yp).alias("fp"),
        F.count_if(yt & ~yp).alias("fn"),
        F.count_if(~yt & ~yp).alias("tn"),
    )


def binary_prf(pred: DataFrame, y: str = "y_true", p: str = "y_pred", positive=1) -> DataFrame:
    """H4: precision, recall and F1 of the positive class (0 when undefined)."""
    c = _binary_counts(pred, y, p, positive)
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return c.select(prec.cast("double").alias("precision"), rec.cast("double").alias("recall"), f1.cast("double").alias("f1"))


def specificity(pred: DataFrame, y: str = "y_true", p: str = "y_pred", positive=1) -> DataFrame:
    """H5: TN / (TN + FP); 0 when the confusion matrix is not 2x2."""
    c = _binary_counts(pred, y, p, positive)
    k = labels(pred, y, p).agg(F.count(F.lit(1)).alias("k"))
    spec = F.coalesce(F.try_divide(F.col("tn"), F.col("tn") + F.col("fp")), F.lit(0.0))
    return c.crossJoin(k).select(F.when(F.col("k") == 2, spec).otherwise(F.lit(0.0)).cast("double").alias("specificity"))


def multiclass_prf(pred: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """H6: macro and support-weighted precision / recall / F1."""
    pc = per_class(pred, y, p)
    w = F.col("support")
    return pc.agg(
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
        F.try_divide(F.sum(F.col("precision") * w), F.sum(w)).alias("precision_weighted"),
        F.try_divide(F.sum(F.col("recall") * w), F.sum(w)).alias("recall_weighted"),
        F.try_divide(F.sum(F.col("f1") * w), F.sum(w)).alias("f1_weighted"),
    )


def classification_report(pred: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """H7: (label, precision, recall, f1, support) per class plus 'accuracy',
    'macro avg' and 'weighted avg' rows."""
    pc = per_class(pred, y, p).select(F.col("label").cast("string").alias("label"), "precision", "recall", "f1", F.col("support").cast("double").alias("support"))
    m = multiclass_prf(pred, y, p)
    n = pred.agg(F.count(F.lit(1)).cast("double").alias("n"))
    acc = accuracy(pred, y, p).crossJoin(n).select(
        F.lit("accuracy").alias("label"), F.col("accuracy").alias("precision"), F.col("accuracy").alias("recall"), F.col("accuracy").alias("f1"), F.col("n").alias("support")
    )
    macro = m.crossJoin(n).select(F.lit("macro avg").alias("label"), F.col("precision_macro").alias("precision"), F.col("recall_macro").alias("recall"), F.col("f1_macro").alias("f1"), F.col("n").alias("support"))
    weighted = m.crossJoin(n).select(F.lit("weighted avg").alias("label"), F.col("precision_weighted").alias("precision"), F.col("recall_weighted").alias("recall"), F.col("f1_weighted").alias("f1"), F.col("n").alias("support"))
    return pc.unionByName(acc).unionByName(macro).unionByName(weighted)


# ---------------------------------------------------------------- H8-H12 curves and AUC

def score_table(pred: DataFrame, score: str, positive: Column, group: Column | None = None) -> DataFrame:
    """(g, s, pos, neg): positive / negative counts per distinct score."""
    g = group if group is not None else F.lit(0)
    return pred.where(F.col(score).isNotNull()).groupBy(g.alias("g"), F.col(score).cast("double").alias("s")).agg(
        F.count_if(positive).cast("double").alias("pos"), F.count_if(~positive).cast("double").alias("neg")
    )


def roc_curve(pred: DataFrame, y: str = "y_true", score: str = "score", positive=1) -> DataFrame:
    """H8: (threshold, fpr, tpr) at every distinct score, thresholds descending
    (collinear points are kept), after the start point (+inf, 0, 0)."""
    st = score_table(pred, score, F.col(y) == F.lit(positive))
    cum = cumulative_by_value(st, ["g"], "s", ["pos", "neg"], descending=True)
    points = cum.select(
        F.col("s").alias("threshold"),
        F.try_divide(F.col("cum_neg"), F.col("total_neg")).alias("fpr"),
        F.try_divide(F.col("cum_pos"), F.col("total_pos")).alias("tpr"),
    )
    start = pred.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return start.unionByName(points)


def _auc_from_table(st: DataFrame) -> DataFrame:
    """Tie-aware AUC per group g: sum pos * (neg below + neg tied / 2) / (P N)."""
    cum = cumulative_by_value(st, ["g"], "s", ["neg"])
    return cum.groupBy("g").agg(
        F.try_divide(
            F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") / 2)),
            F.sum("pos") * F.max("total_neg"),
        ).alias("auc")
    )


def roc_auc(pred: DataFrame, y: str = "y_true", score: str = "score", positive=1, by: str | None = None) -> DataFrame:
    """H9: area under the ROC curve (ties count one half); with ``by`` one row
    for each of its values."""
    st = score_table(pred, score, F.col(y) == F.lit(positive), F.col(by) if by else None)
    return _auc_from_table(st).select(*([F.col("g").alias(by)] if by else []), F.col("auc").alias("roc_auc"))


def average_precision(pred: DataFrame, y: str = "y_true", score: str = "score", positive=1) -> DataFrame:
    """Step-wise AP = sum over distinct thresholds of (R_k - R_k-1) * P_k."""
    st = score_table(pred, score, F.col(y) == F.lit(positive))
    cum = cumulative_by_value(st, ["g"], "s", ["pos", "neg"], descending=True)
    return cum.agg(
        F.try_divide(F.sum(F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))), F.max("total_pos")).alias("average_precision")
    )


def log_loss_binary(pred: DataFrame, y: str = "y_true", score: str = "score", positive=1) -> DataFrame:
    """H11 (binary): -mean(ln p(true class)), p clipped to [eps, 1-eps]."""
    p = F.greatest(F.least(F.col(score).cast("double"), F.lit(1 - EPS)), F.lit(EPS))
    pt = F.when(F.col(y) == F.lit(positive), p).otherwise(1 - p)
    return pred.agg((-F.avg(F.ln(pt))).alias("log_loss"))


def log_loss_multiclass(pred: DataFrame, classes: list, prob_cols: list[str], y: str = "y_true") -> DataFrame:
    """H11 (multiclass): probabilities renormalised to sum 1 after clipping."""
    clipped = [F.greatest(F.least(F.col(c).cast("double"), F.lit(1 - EPS)), F.lit(EPS)) for c in prob_cols]
    total = clipped[0]
    for c in clipped[1:]:
        total = total + c
    pt = F.lit(None).cast("double")
    for cls, c in zip(classes, clipped):
        pt = F.when(F.col(y) == F.lit(cls), c).otherwise(pt)
    return pred.agg((-F.avg(F.ln(pt / total))).alias("log_loss"))


def roc_auc_multiclass(pred: DataFrame, classes: list, prob_cols: list[str], y: str = "y_true") -> DataFrame:
    """Macro one-vs-rest and one-vs-one AUC. All class problems are one
    explode + one score table grouped by problem."""
    # one row per (row, class of the score): its own class decides which problems
    # it belongs to, so a row makes classes + 2 (classes - 1) rows, not classes^2
    index = F.lit(None).cast("int")
    for i, c in enumerate(classes):
        index = F.when(F.col(y) == F.lit(c), F.lit(i)).otherwise(index)
    scores = F.array(*[F.col(c).cast("double") for c in prob_cols])
    k = len(classes)
    x = pred.select(index.alias("t"), scores.alias("p"))
    # problems are numbers: class i against the rest is i, class a against b > a by the score of i is k + (a k + b) k + i
    name = lambda a, b, i: F.lit(k) + (F.least(a, b).cast("long") * k + F.greatest(a, b)) * k + i
    each = x.select("t", "p", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i"))
    ovr = each.select(F.col("i").cast("long").alias("g"), F.element_at("p", F.col("i") + 1).alias("s"), F.coalesce(F.col("t") == F.col("i"), F.lit(False)).alias("positive"))
    other = each.where(F.col("t").isNotNull() & (F.col("i") != F.col("t")))
    t, i = F.col("t"), F.col("i")
    own = other.select(name(t, i, t).alias("g"), F.element_at("p", t + 1).alias("s"), F.lit(True).alias("positive"))
    rival = other.select(name(t, i, i).alias("g"), F.element_at("p", i + 1).alias("s"), F.lit(False).alias("positive"))
    x = ovr.unionByName(own).unionByName(rival).where(F.col("s").isNotNull())
    st = x.groupBy("g", "s").agg(F.count_if("positive").cast("double").alias("pos"), F.count_if(~F.col("positive")).cast("double").alias("neg"))
    auc = materialize(_auc_from_table(st))  # a row a problem, read twice
    pairs = auc.where(F.col("g") >= k).groupBy(F.floor((F.col("g") - k) / k).alias("pair")).agg(F.avg("auc").alias("auc"))
    ovr_auc = auc.where(F.col("g") < k).agg(F.avg("auc").alias("roc_auc_ovr"))
    ovo_auc = pairs.agg(F.avg("auc").alias("roc_auc_ovo"))
    return ovr_auc.crossJoin(ovo_auc)


# ---------------------------------------------------------------- H13-H18 regression and summaries

def regression_metrics(pred: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Mae, mse, rmse, r2, mape (over y != 0; +inf if none), explained
    variance, max error, mean and (population) std of the residual."""
    yt, yp = F.col(y).cast("double"), F.col(p).cast("double")
    res = yt - yp
    a = pred.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(res)).alias("mae"),
        F.avg(res * res).alias("mse"),
        F.sum(res * res).alias("sse"),
        (F.var_pop(yt) * F.count(F.lit(1))).alias("sst"),
        F.avg(F.when(yt != 0, F.abs(res) / F.abs(yt))).alias("mape"),
        F.var_pop(res).alias("var_res"),
        F.var_pop(yt).alias("var_y"),
        F.max(F.abs(res)).alias("max_error"),
        F.avg(res).alias("mean_residual"),
        F.stddev_pop(res).alias("std_residual"),
    )
    r2 = F.when(F.col("sst") == 0, F.when(F.col("sse") == 0, 1.0).otherwise(0.0)).otherwise(1 - F.col("sse") / F.col("sst"))
    ev = F.when(F.col("var_y") == 0, F.when(F.col("var_res") == 0, 1.0).otherwise(0.0)).otherwise(1 - F.col("var_res") / F.col("var_y"))
    return a.select(
        "n",
        "mae",
        "mse",
        F.sqrt("mse").alias("rmse"),
        r2.alias("r2"),
        F.coalesce(F.col("mape"), F.lit(float("inf"))).alias("mape"),
        ev.alias("explained_variance"),
        "max_error",
        "mean_residual",
        "std_residual",
    )


def adjusted_r2(reg: DataFrame, p: int = 1) -> DataFrame:
    """1 - (1 - r2)(n - 1)/(n - p - 1); r2 itself when n <= p + 1."""
    return reg.select(
        F.when(F.col("n") > p + 1, 1 - (1 - F.col("r2")) * (F.col("n") - 1) / (F.col("n") - p - 1)).otherwise(F.col("r2")).alias("adjusted_r2")
    )


def residual_table(pred: DataFrame, y: str = "y_true", p: str = "y_pred", keys: list[str] | None = None) -> DataFrame:
    """Predicted value and residual per row."""
    return pred.select(*(keys or []), F.col(p).cast("double").alias("predicted"), (F.col(y) - F.col(p)).cast("double").alias("residual"))


def prediction_intervals(pred: DataFrame, y: str = "y_true", p: str = "y_pred", confidence: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """(rows with lower/upper bounds, one summary row: margin, coverage,
    confidence). The margin is z * std_pop(residual); the 1-row statistic is
    broadcast back to the rows."""
    z = normal_quantile((1 + confidence) / 2)
    sd = pred.agg((F.lit(z) * F.stddev_pop(F.col(y) - F.col(p))).alias("margin"))
    rows = pred.crossJoin(F.broadcast(sd)).select(
        "*", (F.col(p) - F.col("margin")).alias("lower_bound"), (F.col(p) + F.col("margin")).alias("upper_bound")
    )
    summary = rows.agg(
        F.max("margin").alias("margin_of_error"),
        F.avg(((F.col(y) >= F.col("lower_bound")) & (F.col(y) <= F.col("upper_bound"))).cast("double")).alias("coverage"),
    ).withColumn("confidence_level", F.lit(float(confidence)))
    return rows, summary


def cv_score_summary(scores: DataFrame, group_cols: list[str] | None = None, value: str = "value") -> DataFrame:
    """Mean, std (population), min, max, median and fold count per group
    (e.g. run, model, metric). Fold groups are small, so the exact median
    is a plain aggregate."""
    g = group_cols or ["run", "model", "metric"]
    v = F.col(value)
    return scores.groupBy(*g).agg(
        F.avg(v).alias("cv_mean"),
        F.stddev_pop(v).alias("cv_std"),
        F.min(v).alias("cv_min"),
        F.max(v).alias("cv_max"),
        F.median(v).alias("cv_median"),
        F.count(v).alias("n_folds"),
    )


# The key metrics of each task, in display order.
CLASSIFICATION_TABLE = ["accuracy", "balanced_accuracy", "f1", "precision", "recall", "f1_weighted", "roc_auc", "pr_auc", "log_loss"]
REGRESSION_TABLE = ["mae", "rmse", "r2", "mape", "explained_variance", "adjusted_r2"]


def _display_name(metric: str, task: str) -> str:
    if task == "regression":
        return metric.replace("_", " ").upper()
    if metric == "log_loss":
        return "Log Loss"
    return metric.replace("_", " ").title()


def metrics_table(metrics_row: DataFrame, task: str) -> DataFrame:
    """(metric, value) text rows for the key metrics present in a
    one-row metrics frame; 4 decimals, infinite MAPE shown as N/A."""
    keys = CLASSIFICATION_TABLE if task == "classification" else REGRESSION_TABLE
    present = [k for k in keys if k in metrics_row.columns]
    rows = []
    for i, k in enumerate(present):
        v = F.col(k).cast("double")
        txt = F.format_string("%.4f", v)
        if k == "mape":
            txt = F.when(v == float("inf"), F.lit("N/A")).otherwise(txt)
        rows.append(F.struct(F.lit(i).alias("pos"), F.lit(_display_name(k, task)).alias("metric"), txt.alias("value")))
    return metrics_row.select(F.explode(F.array(*rows)).alias("_m")).select("_m.*")


