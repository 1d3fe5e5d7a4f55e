
from pyspark.sql import functions as F

from tabsleuth.operators import clean, profile
from tabsleuth.operators.distributions import class_balance, describe_numeric, histogram

from conftest import SF001


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "b"), (None, "b"), (3.0, None), (3.0, "a")], "x double, s string")
    prof = {r["column"]: r for r in profile.column_profile(df).collect()}
    assert prof["x"]["missing_count"] == 2
    assert prof["x"]["unique_count"] == 2
    assert prof["s"]["missing_count"] == 1
    ov = profile.dataset_overview(df).first()
    assert ov["missing_values"] == 3
    d = {r["column"]: r for r in describe_numeric(df).collect()}
    assert d["x"]["count"] == 3 and abs(d["x"]["mean"] - 7 / 3) < 1e-12


def test_all_null_single_value_and_empty(spark):
    df = spark.createDataFrame([(None, 5.0), (None, 5.0), (None, 5.0)], "a string, b double")
    prof = {r["column"]: r for r in profile.column_profile(df).collect()}
    assert prof["a"]["unique_count"] == 0 and prof["a"]["is_constant"] and prof["a"]["semantic_type"] == "text"
    assert prof["b"]["is_constant"] and prof["b"]["semantic_type"] == "numeric"
    empty = spark.createDataFrame([], "a double, b string")
    ov = profile.dataset_overview(empty).first()
    assert ov["total_rows"] == 0 and ov["missing_percentage"] is None
    d = describe_numeric(empty).collect()
    assert d[0]["count"] == 0 and d[0]["mean"] is None


def test_datetime_probe_and_categorical(spark):
    df = spark.createDataFrame([("2024-01-0%d" % (i % 9 + 1), "k%d" % (i % 3)) for i in range(300)], "d string, k string")
    prof = {r["column"]: r for r in profile.column_profile(df).collect()}
    assert prof["d"]["semantic_type"] == "datetime"
    assert prof["k"]["semantic_type"] == "categorical"


def test_id_like_needs_more_than_100_rows(spark):
    sup = spark.read.parquet(f"{SF001}/supplier.parquet")
    prof = {r["column"]: r for r in profile.column_profile(sup).collect()}
    n = prof["s_suppkey"]["n_rows"]
    assert prof["s_suppkey"]["is_id_like"] == (n > 100)


def test_mode_tie_goes_to_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,)], "s string")
    assert clean.modes(df, ["s"])["s"] == "a"
    filled = clean.fill_median_mode(df).where(F.col("s").isNull()).count()
    assert filled == 0


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 2, 3, 4, 10]], "v double")
    h = {r["bin"]: r["count"] for r in histogram(df, ["v"], bins=5).collect()}
    assert sum(h.values()) == 6 and h[4] == 1 and h[0] == 2
    const = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    hc = {r["bin"]: r["count"] for r in histogram(const, ["v"], bins=3).collect()}
    assert hc[0] == 2


def test_class_balance_counts_nulls_in_majority(spark):
    df = spark.createDataFrame([(1,)] * 8 + [(0,)] + [(None,)], "y int")
    r = class_balance(df, "y").first()
    assert abs(r["majority_ratio"] - 0.8) < 1e-12 and r["class_balance"] == "imbalanced"


def test_duplicates(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x"), (2, "x"), (2, "x")], "a int, b string")
    assert clean.count_duplicate_rows(df).first()[0] == 3
    assert clean.drop_duplicate_rows(df).count() == 2
