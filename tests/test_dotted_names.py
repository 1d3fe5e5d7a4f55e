"""Every operator that names columns runs on names with a dot and gives the
result it gives on plain names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsleuth.operators import clean, distributions, models, prep, profile, relations, target

PLAIN = ["k", "x", "y", "s", "t", "w"]
DOTTED = ["k.id", "x.1", "y.raw", "s.text", "t.cat", "x.1__raw"]


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(rng.normal()) if i % 9 else None, float(rng.integers(0, 3)), "abc"[int(rng.integers(3))] if i % 7 else None, "uv"[int(rng.integers(2))], float(i % 4)) for i in range(120)]
    df = spark.createDataFrame(rows, "k long, x double, y double, s string, t string, w double")
    return df, df.toDF(*DOTTED)


def _plain(v):
    for d, p in sorted(zip(DOTTED, PLAIN, strict=True), key=lambda x: -len(x[0])):
        v = v.replace(d, p) if isinstance(v, str) else v
    return round(v, 9) if isinstance(v, float) else v


def _rows(df):
    return sorted((tuple(_plain(v) for v in r) for r in df.collect()), key=str)


OPERATORS = {
    "drop_zero_variance": lambda df, n: clean.drop_zero_variance(df)[0],
    "fill_missing_label": lambda df, n: clean.fill_missing_label(df),
    "fill_median_mode": lambda df, n: clean.fill_median_mode(df),
    "label_encode": lambda df, n: clean.label_encode(df),
    "duplicate_columns": lambda df, n: clean.duplicate_columns(df),
    "pairwise_dropna": lambda df, n: clean.pairwise_dropna(df, n["x"], n["s"]),
    "count_duplicate_rows": lambda df, n: clean.count_duplicate_rows(df),
    "value_counts": lambda df, n: distributions.class_distribution(df, n["t"]),
    "scatter_points": lambda df, n: distributions.scatter_points(df, n["x"], n["y"]),
    "quality_findings": lambda df, n: clean.quality_findings(df),
    "column_profile": lambda df, n: profile.column_profile(df),
    "outliers_iqr": lambda df, n: profile.outliers_iqr(df),
    "describe_numeric": lambda df, n: distributions.describe_numeric(df),
    "histogram": lambda df, n: distributions.histogram(df),
    "pearson": lambda df, n: relations.pearson(df),
    "spearman": lambda df, n: relations.spearman(df),
    "vif": lambda df, n: relations.vif(df),
    "cramers_v_matrix": lambda df, n: relations.cramers_v_matrix(df),
    "anova_f": lambda df, n: relations.anova_f(df),
    "point_biserial": lambda df, n: relations.point_biserial(df),
    "pairwise_mi": lambda df, n: relations.pairwise_mi(df),
    "mi_to_target": lambda df, n: relations.mi_to_target(df, n["t"]),
    "target_candidates": lambda df, n: target.target_candidates(df).select("column", "position_score", "predictability_score") if "predictability_score" in target.target_candidates(df).columns else target.target_candidates(df).select("column"),
    "infer_task": lambda df, n: target.infer_task(df, n["t"]),
    "target_profile": lambda df, n: target.target_profile(df, n["t"], "classification"),
    "stratified_split": lambda df, n: prep.stratified_split(df, n["t"], n["k"]),
    "random_split": lambda df, n: prep.random_split(df, n["k"]),
    "assign_folds": lambda df, n: prep.assign_folds(df, n["k"], n["t"]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_takes_names_with_a_dot(tables, name):
    plain, dotted = tables
    run = OPERATORS[name]
    assert _rows(run(dotted, dict(zip(PLAIN, DOTTED, strict=True)))) == _rows(run(plain, dict(zip(PLAIN, PLAIN, strict=True))))


def test_label_encode_with_large_dictionaries(tables, monkeypatch):
    monkeypatch.setattr(clean, "DICTIONARY_BYTES", 0)
    plain, _ = tables
    big = _rows(clean.label_encode(plain))
    monkeypatch.undo()
    assert big == _rows(clean.label_encode(plain))


def test_training_takes_names_with_a_dot(tables):
    _, dotted = tables
    run = models.train_baselines(dotted, "t.cat", "k.id", "classification", ["x.1", "s.text"], models=["Naive Bayes", models.KNN], cv_folds=2)
    assert run.results.where(F.col("error").isNotNull()).count() == 0
