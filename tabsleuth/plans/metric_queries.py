"""Registered queries for evaluation metrics."""

from __future__ import annotations

from ..operators import distributions as ds
from ..operators import metrics as mt
from . import fixtures as fx
from .registry import finish, r, register

EPS = 2.220446049250313e-16  # the oracle's own copy of the float64 machine epsilon
Z95 = 1.959963984540054
CLASSES = fx.PRED_MULTI_CLASSES
PROBS = [f"p_{c}" for c in CLASSES]


def W(sql: str, *names: str) -> str:
    return fx.with_fixtures(sql, *names)


# ---------------------------------------------------------------- binary

_ACC = "SELECT {} AS accuracy FROM {}"


@register("accuracy", W(_ACC.format(r("avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END)"), "pred_binary"), "pred_binary"))
def q_accuracy(spark, sf_dir):
    return finish(mt.accuracy(fx.pred_binary(spark, sf_dir)))


@register("accuracy_multiclass", W(_ACC.format(r("avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END)"), "pred_multi"), "pred_multi"))
def q_accuracy_multiclass(spark, sf_dir):
    return finish(mt.accuracy(fx.pred_multi(spark, sf_dir)))


def _confusion_sql(t: str) -> str:
    lb = f"(SELECT y_true AS l FROM {t} UNION SELECT y_pred FROM {t})"
    return (f"SELECT a.l AS actual, p.l AS predicted, CAST(coalesce(k.n, 0) AS BIGINT) AS \"count\" FROM {lb} a CROSS JOIN {lb} p "
            f"LEFT JOIN (SELECT y_true, y_pred, count(*) AS n FROM {t} GROUP BY 1, 2) k ON k.y_true = a.l AND k.y_pred = p.l")


@register("confusion_matrix", W(_confusion_sql("pred_multi"), "pred_multi"))
def q_confusion_matrix(spark, sf_dir):
    return finish(mt.confusion_matrix(fx.pred_multi(spark, sf_dir)))


@register("confusion_matrix_binary", W(_confusion_sql("pred_binary"), "pred_binary"))
def q_confusion_matrix_binary(spark, sf_dir):
    return finish(mt.confusion_matrix(fx.pred_binary(spark, sf_dir)))


def _per_class_sql(t: str) -> str:
    lb = f"(SELECT y_true AS l FROM {t} UNION SELECT y_pred FROM {t})"
    return (
        f"SELECT l AS label, tp, support, npred, coalesce(tp / nullif(npred, 0), 0.0) AS prec, coalesce(tp / nullif(support, 0), 0.0) AS rec "
        f"FROM (SELECT lb.l, (SELECT count(*) FROM {t} WHERE y_true = lb.l AND y_pred = lb.l)::DOUBLE AS tp, "
        f"(SELECT count(*) FROM {t} WHERE y_true = lb.l)::DOUBLE AS support, (SELECT count(*) FROM {t} WHERE y_pred = lb.l)::DOUBLE AS npred "
        f"FROM {lb} lb)"
    )


def _pcf(t: str) -> str:
    return f"SELECT *, coalesce(2 * prec * rec / nullif(prec + rec, 0), 0.0) AS f1 FROM ({_per_class_sql(t)})"


@register("balanced_accuracy", W(f"SELECT {r('avg(rec)')} AS balanced_accuracy FROM ({_pcf('pred_multi')}) WHERE support > 0", "pred_multi"))
def q_balanced_accuracy(spark, sf_dir):
    return finish(mt.balanced_accuracy(fx.pred_multi(spark, sf_dir)))


@register("balanced_accuracy_binary", W(f"SELECT {r('avg(rec)')} AS balanced_accuracy FROM ({_pcf('pred_binary')}) WHERE support > 0", "pred_binary"))
def q_balanced_accuracy_binary(spark, sf_dir):
    return finish(mt.balanced_accuracy(fx.pred_binary(spark, sf_dir)))


_BIN = ("SELECT count(*) FILTER (WHERE y_true = 1 AND y_pred = 1)::DOUBLE AS tp, count(*) FILTER (WHERE y_true <> 1 AND y_pred = 1)::DOUBLE AS fp, "
        "count(*) FILTER (WHERE y_true = 1 AND y_pred <> 1)::DOUBLE AS fn, count(*) FILTER (WHERE y_true <> 1 AND y_pred <> 1)::DOUBLE AS tn FROM pred_binary")


@register("binary_prf", W(
    f"SELECT {r('coalesce(tp / nullif(tp + fp, 0), 0.0)')} AS precision, {r('coalesce(tp / nullif(tp + fn, 0), 0.0)')} AS recall, "
    f"{r('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0)')} AS f1 FROM ({_BIN})", "pred_binary"))
def q_binary_prf(spark, sf_dir):
    return finish(mt.binary_prf(fx.pred_binary(spark, sf_dir)))


@register("specificity", W(
    f"SELECT CASE WHEN (SELECT count(*) FROM (SELECT y_true FROM pred_binary UNION SELECT y_pred FROM pred_binary)) = 2 "
    f"THEN {r('coalesce(tn / nullif(tn + fp, 0), 0.0)')} ELSE 0.0 END AS specificity FROM ({_BIN})", "pred_binary"))
def q_specificity(spark, sf_dir):
    return finish(mt.specificity(fx.pred_binary(spark, sf_dir)))


_MPRF = ("SELECT avg(prec) AS precision_macro, avg(rec) AS recall_macro, avg(f1) AS f1_macro, sum(prec * support) / sum(support) AS precision_weighted, "
         "sum(rec * support) / sum(support) AS recall_weighted, sum(f1 * support) / sum(support) AS f1_weighted FROM ({})")


@register("multiclass_prf", W(
    "SELECT " + ", ".join(f"{r(c)} AS {c}" for c in ["precision_macro", "recall_macro", "f1_macro", "precision_weighted", "recall_weighted", "f1_weighted"])
    + " FROM (" + _MPRF.format(_pcf("pred_multi")) + ")", "pred_multi"))
def q_multiclass_prf(spark, sf_dir):
    return finish(mt.multiclass_prf(fx.pred_multi(spark, sf_dir)))


@register("classification_report", W(
    f"SELECT label, {r('prec')} AS precision, {r('rec')} AS recall, {r('f1')} AS f1, support FROM ({_pcf('pred_multi')}) "
    f"UNION ALL SELECT 'accuracy', {r('a')}, {r('a')}, {r('a')}, n FROM (SELECT avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) AS a, count(*)::DOUBLE AS n FROM pred_multi) "
    f"UNION ALL SELECT 'macro avg', {r('precision_macro')}, {r('recall_macro')}, {r('f1_macro')}, (SELECT count(*)::DOUBLE FROM pred_multi) FROM ({_MPRF.format(_pcf('pred_multi'))}) "
    f"UNION ALL SELECT 'weighted avg', {r('precision_weighted')}, {r('recall_weighted')}, {r('f1_weighted')}, (SELECT count(*)::DOUBLE FROM pred_multi) FROM ({_MPRF.format(_pcf('pred_multi'))})",
    "pred_multi"))
def q_classification_report(spark, sf_dir):
    return finish(mt.classification_report(fx.pred_multi(spark, sf_dir)))


_SCORES = ("WITH s AS (SELECT score, sum(CASE WHEN y_true = 1 THEN 1 ELSE 0 END)::DOUBLE AS pos, sum(CASE WHEN y_true = 1 THEN 0 ELSE 1 END)::DOUBLE AS neg "
           "FROM pred_binary GROUP BY score), c AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS cp, "
           "sum(neg) OVER (ORDER BY score DESC) AS cn, sum(pos) OVER () AS tp_all, sum(neg) OVER () AS tn_all FROM s) ")


@register("roc_curve", W(_SCORES + f"SELECT score::DOUBLE AS threshold, {r('cn / tn_all')} AS fpr, {r('cp / tp_all')} AS tpr FROM c UNION ALL SELECT 'inf'::DOUBLE, 0.0, 0.0", "pred_binary").replace(") WITH s AS", "), s AS"))
def q_roc_curve(spark, sf_dir):
    return finish(mt.roc_curve(fx.pred_binary(spark, sf_dir)), keep=("threshold",))


@register("roc_auc", W(
    "SELECT " + r("(sum(rk) FILTER (WHERE y_true = 1) - P * (P + 1) / 2) / (P * N)") + " AS roc_auc FROM ("
    "SELECT y_true, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk, "
    "count(*) FILTER (WHERE y_true = 1) OVER () AS P, count(*) FILTER (WHERE y_true <> 1) OVER () AS N FROM pred_binary) GROUP BY P, N",
    "pred_binary"))
def q_roc_auc(spark, sf_dir):
    return finish(mt.roc_auc(fx.pred_binary(spark, sf_dir)))


@register("average_precision", W(_SCORES + f"SELECT {r('sum(pos * cp / (cp + cn)) / max(tp_all)')} AS average_precision FROM c", "pred_binary").replace(") WITH s AS", "), s AS"))
def q_average_precision(spark, sf_dir):
    return finish(mt.average_precision(fx.pred_binary(spark, sf_dir)))


@register("log_loss", W(
    f"SELECT {r(f'-avg(ln(CASE WHEN y_true = 1 THEN greatest(least(score, 1 - {EPS!r}), {EPS!r}) ELSE 1 - greatest(least(score, 1 - {EPS!r}), {EPS!r}) END))')} AS log_loss FROM pred_binary",
    "pred_binary"))
def q_log_loss(spark, sf_dir):
    return finish(mt.log_loss_binary(fx.pred_binary(spark, sf_dir)))


def _clip(c: str) -> str:
    return f"greatest(least({c}, 1 - {EPS!r}), {EPS!r})"


@register("log_loss_multiclass", W(
    "SELECT " + r("-avg(ln(CASE " + " ".join(f"WHEN y_true = '{c}' THEN {_clip(p)}" for c, p in zip(CLASSES, PROBS))
                  + " END / (" + " + ".join(_clip(p) for p in PROBS) + ")))") + " AS log_loss FROM pred_multi", "pred_multi"))
def q_log_loss_multiclass(spark, sf_dir):
    return finish(mt.log_loss_multiclass(fx.pred_multi(spark, sf_dir), CLASSES, PROBS))


def _auc_sql(src: str, score: str, positive: str) -> str:
    return (f"SELECT (sum(rk) FILTER (WHERE pos) - P * (P + 1) / 2) / (P * N) AS auc FROM (SELECT {positive} AS pos, "
            f"rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2.0 AS rk, "
            f"count(*) FILTER (WHERE {positive}) OVER () AS P, count(*) FILTER (WHERE NOT ({positive})) OVER () AS N FROM {src}) GROUP BY P, N")


def _auc_multi_sql() -> str:
    ovr = " UNION ALL ".join(_auc_sql("pred_multi", p, f"y_true = '{c}'") for c, p in zip(CLASSES, PROBS))
    pairs = []
    for i, (a, pa) in enumerate(zip(CLASSES, PROBS)):
        for j, (b, pb) in enumerate(zip(CLASSES, PROBS)):
            if i < j:
                src = f"(SELECT * FROM pred_multi WHERE y_true IN ('{a}', '{b}'))"
                pairs.append(f"SELECT ((" + _auc_sql(src, pa, f"y_true = '{a}'") + ") + (" + _auc_sql(src, pb, f"y_true = '{b}'") + ")) / 2 AS auc")
    ovo = " UNION ALL ".join(pairs)
    return f"SELECT {r('(SELECT avg(auc) FROM (' + ovr + '))')} AS roc_auc_ovr, {r('(SELECT avg(auc) FROM (' + ovo + '))')} AS roc_auc_ovo"


@register("roc_auc_multiclass", W(_auc_multi_sql(), "pred_multi"))
def q_roc_auc_multiclass(spark, sf_dir):
    return finish(mt.roc_auc_multiclass(fx.pred_multi(spark, sf_dir), CLASSES, PROBS))


# ---------------------------------------------------------------- regression

def _reg_sql(y: str, p: str) -> str:
    return (
        f"SELECT count(*) AS n, {r(f'avg(abs({y} - {p}))')} AS mae, {r(f'avg(pow({y} - {p}, 2))', 2)} AS mse, {r(f'sqrt(avg(pow({y} - {p}, 2)))')} AS rmse, "
        f"{r(f'1 - sum(pow({y} - {p}, 2)) / sum(pow({y} - (SELECT avg({y}) FROM pred_reg), 2))')} AS r2, "
        f"{r(f'coalesce(avg(abs({y} - {p}) / abs({y})) FILTER (WHERE {y} <> 0), ' + chr(39) + 'inf' + chr(39) + '::DOUBLE)')} AS mape, "
        f"{r(f'1 - var_pop({y} - {p}) / var_pop({y})')} AS explained_variance, {r(f'max(abs({y} - {p}))')} AS max_error, "
        f"{r(f'avg({y} - {p})')} AS mean_residual, {r(f'stddev_pop({y} - {p})')} AS std_residual FROM pred_reg"
    )


@register("regression_metrics", W(_reg_sql("y_true", "y_pred"), "pred_reg"))
def q_regression_metrics(spark, sf_dir):
    return finish(mt.regression_metrics(fx.pred_reg(spark, sf_dir)), per_column={"mse": 2})


@register("regression_metrics_zero_targets", W(_reg_sql("y_small", "y_small_pred"), "pred_reg"))
def q_regression_metrics_zero_targets(spark, sf_dir):
    return finish(mt.regression_metrics(fx.pred_reg(spark, sf_dir), "y_small", "y_small_pred"), per_column={"mse": 2})


@register("adjusted_r2", W(
    f"SELECT {r('CASE WHEN n > 2 THEN 1 - (1 - r2) * (n - 1) / (n - 2) ELSE r2 END')} AS adjusted_r2 FROM ("
    "SELECT count(*) AS n, 1 - sum(pow(y_true - y_pred, 2)) / sum(pow(y_true - (SELECT avg(y_true) FROM pred_reg), 2)) AS r2 FROM pred_reg)", "pred_reg"))
def q_adjusted_r2(spark, sf_dir):
    return finish(mt.adjusted_r2(mt.regression_metrics(fx.pred_reg(spark, sf_dir))))


@register("residual_table", W("SELECT id, line, y_pred AS predicted, y_true - y_pred AS residual FROM pred_reg", "pred_reg"))
def q_residual_table(spark, sf_dir):
    return finish(mt.residual_table(fx.pred_reg(spark, sf_dir), keys=["id", "line"]))


@register("residual_histogram", W(
    "WITH rs AS (SELECT y_true - y_pred AS residual FROM pred_reg) "
    "SELECT 'residual' AS \"column\", CAST(g.bin AS INTEGER) AS bin, " + r("q.lo + g.bin * (q.hi - q.lo) / 20") + " AS bin_start, "
    + r("q.lo + (g.bin + 1) * (q.hi - q.lo) / 20") + " AS bin_end, CAST(coalesce(k.cnt, 0) AS BIGINT) AS \"count\" "
    "FROM (SELECT min(residual) AS lo, max(residual) AS hi FROM rs) q CROSS JOIN (SELECT range AS bin FROM range(0, 20)) g "
    "LEFT JOIN (SELECT least(floor((residual - lo) / (hi - lo) * 20), 19) AS b, count(*) AS cnt FROM rs, "
    "(SELECT min(residual) AS lo, max(residual) AS hi FROM rs) GROUP BY 1) k ON k.b = g.bin", "pred_reg").replace(") WITH rs AS", "), rs AS"))
def q_residual_histogram(spark, sf_dir):
    res = mt.residual_table(fx.pred_reg(spark, sf_dir))
    return finish(ds.histogram(res.select("residual"), ["residual"], bins=20))


@register("prediction_intervals", W(
    f"SELECT {r('m')} AS margin_of_error, {r('avg(CASE WHEN y_true >= y_pred - m AND y_true <= y_pred + m THEN 1.0 ELSE 0.0 END)')} AS coverage, "
    f"0.95 AS confidence_level FROM pred_reg, (SELECT {Z95!r} * stddev_pop(y_true - y_pred) AS m FROM pred_reg) GROUP BY m", "pred_reg"))
def q_prediction_intervals(spark, sf_dir):
    _, summary = mt.prediction_intervals(fx.pred_reg(spark, sf_dir))
    return finish(summary)


@register("cv_score_summary", W(
    f"SELECT run, model, metric, {r('avg(value)')} AS cv_mean, {r('stddev_pop(value)')} AS cv_std, {r('min(value)')} AS cv_min, "
    f"{r('max(value)')} AS cv_max, {r('median(value)')} AS cv_median, count(value) AS n_folds FROM cv_scores GROUP BY run, model, metric", "cv_scores"))
def q_cv_score_summary(spark, sf_dir):
    return finish(mt.cv_score_summary(fx.cv_scores(spark, sf_dir)))


def _binary_metrics_row(spark, sf_dir):
    p = fx.pred_binary(spark, sf_dir)
    parts = [mt.accuracy(p), mt.balanced_accuracy(p), mt.binary_prf(p), mt.roc_auc(p),
             mt.average_precision(p).withColumnRenamed("average_precision", "pr_auc"), mt.log_loss_binary(p)]
    out = parts[0]
    for x in parts[1:]:
        out = out.crossJoin(x)  # one-row frames
    return out


@register("metrics_table", W(
    "SELECT pos, metric, printf('%.4f', v) AS value FROM (VALUES "
    "(0, 'Accuracy', (SELECT avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) FROM pred_binary)), "
    f"(1, 'Balanced Accuracy', (SELECT avg(rec) FROM ({_pcf('pred_binary')}) WHERE support > 0)), "
    "(2, 'F1', (SELECT coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) FROM (" + _BIN + "))), "
    "(3, 'Precision', (SELECT coalesce(tp / nullif(tp + fp, 0), 0.0) FROM (" + _BIN + "))), "
    "(4, 'Recall', (SELECT coalesce(tp / nullif(tp + fn, 0), 0.0) FROM (" + _BIN + "))), "
    "(5, 'Roc Auc', (" + _auc_sql("pred_binary", "score", "y_true = 1") + ")), "
    "(6, 'Pr Auc', (" + _SCORES + "SELECT sum(pos * cp / (cp + cn)) / max(tp_all) FROM c)), "
    f"(7, 'Log Loss', (SELECT -avg(ln(CASE WHEN y_true = 1 THEN {_clip('score')} ELSE 1 - {_clip('score')} END)) FROM pred_binary))) t(pos, metric, v)",
    "pred_binary"))
def q_metrics_table(spark, sf_dir):
    return mt.metrics_table(_binary_metrics_row(spark, sf_dir), "classification")


@register("metrics_table_regression", W(
    "SELECT pos, metric, CASE WHEN v = 'inf'::DOUBLE THEN 'N/A' ELSE printf('%.4f', v) END AS value FROM (SELECT * FROM (VALUES "
    "(0, 'MAE', (SELECT avg(abs(y_small - y_small_pred)) FROM pred_reg)), "
    "(1, 'RMSE', (SELECT sqrt(avg(pow(y_small - y_small_pred, 2))) FROM pred_reg)), "
    "(2, 'R2', (SELECT 1 - sum(pow(y_small - y_small_pred, 2)) / sum(pow(y_small - (SELECT avg(y_small) FROM pred_reg), 2)) FROM pred_reg)), "
    "(3, 'MAPE', (SELECT coalesce(avg(abs(y_small - y_small_pred) / abs(y_small)) FILTER (WHERE y_small <> 0), 'inf'::DOUBLE) FROM pred_reg)), "
    "(4, 'EXPLAINED VARIANCE', (SELECT 1 - var_pop(y_small - y_small_pred) / var_pop(y_small) FROM pred_reg)), "
    "(5, 'ADJUSTED R2', (SELECT 1 - (1 - (1 - sum(pow(y_small - y_small_pred, 2)) / sum(pow(y_small - (SELECT avg(y_small) FROM pred_reg), 2)))) * (count(*) - 1) / (count(*) - 2) FROM pred_reg))"
    ") t(pos, metric, v))", "pred_reg"))
def q_metrics_table_regression(spark, sf_dir):
    reg = mt.regression_metrics(fx.pred_reg(spark, sf_dir), "y_small", "y_small_pred")
    return mt.metrics_table(reg.crossJoin(mt.adjusted_r2(reg)), "regression")
