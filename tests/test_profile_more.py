import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsleuth.operators import distributions, prep, profile

DATES = {
    "iso": ["2024-01-31", "2024-02-01 10:00"],
    "us": ["1/31/2024", "12/25/2023 5:30 PM"],
    "eu": ["31/1/2024", "25/12/2023"],
    "slash": ["2024/1/31", "2023/12/05"],
    "dots": ["31.01.2024", "5.12.2023 08:15:30"],
    "short month": ["31-Jan-2024", "5 Dec 2023"],
    "month": ["Jan 31, 2024", "Dec 5, 2023"],
    "full month": ["January 31, 2024", "December 5, 2023"],
}
OTHERS = {"mixed": ["1/31/2024", "31/1/2024"], "no day": ["13/45/2024", "1/1/2024"], "numbers": ["2024", "12345"], "words": ["May 2024 was", "x"], "long": ["2024-01-31", "1" * 500]}


@pytest.mark.parametrize("name", [*DATES, *OTHERS])
def test_dates_in_common_formats(spark, name):
    values = (DATES | OTHERS)[name]
    df = spark.createDataFrame([(v,) for v in [*values, None]] * 20, "d string")
    assert (profile.column_profile(df).first()["semantic_type"] == "datetime") == (name in DATES)


def test_samples_have_exactly_their_rows(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 1.5).alias("x"), F.lit("c").alias("t"))
    got = profile.repeated_samples(df, "k", samples=4, rows=50).groupBy("_rep").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("k").alias("u")).collect()
    assert sorted((r["_rep"], r["n"], r["u"]) for r in got) == [(i, 50, 50) for i in range(4)]
    same_key = df.withColumn("k", F.lit(1))  # equal keys, so equal hashes: the threshold has to rise
    assert {r["n"] for r in profile.repeated_samples(same_key, "k", samples=3, rows=50).groupBy("_rep").agg(F.count(F.lit(1)).alias("n")).collect()} == {50}
    few = {r["column"]: r["stability"] for r in profile.feature_stability(df.limit(30), "k", ["x", "t"]).collect()}
    assert few == {"x": 1.0, "t": 1.0}


def test_automatic_bins_are_those_of_numpy(spark):
    rng = np.random.default_rng(1)
    for x in (rng.normal(size=500), rng.exponential(size=1000), np.repeat([1.0, 2.0], 40), np.full(9, 3.0)):
        df = spark.createDataFrame([(float(v),) for v in x], "v double")
        want, edges = np.histogram(x, bins="auto")
        got = distributions.histogram(df, ["v"], bins="auto").orderBy("bin").collect()
        assert len(got) == len(want)
        if len(want) > 1:
            assert [r["bin_start"] for r in got] == pytest.approx(list(edges[:-1]))
            assert sum(r["count"] for r in got) == len(x)


def test_automatic_bins_without_an_iqr():
    assert distributions.automatic_bins(100, 0.0, 9.0, 0.0) == 8  # Sturges alone
    assert distributions.automatic_bins(0, 0.0, 0.0, 0.0) == 1


def test_sparse_features_equal_the_columns(spark):
    rows = [(i, float(i), "abcdefghijklmnopqrstuvwxyz"[i % 26] if i % 5 else None, "z" if i % 2 else None, None) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, x double, `many.levels` string, one string, none string")
    fitted = prep.preprocess_fit(df.where("k < 150"), ["x", "many.levels", "one", "none"])
    unseen = df.unionByName(spark.createDataFrame([(900, 1.0, "?", "!", "x")], df.schema))
    dense = {r["k"]: list(r)[1:] for r in prep.preprocess_apply(unseen, fitted, keep=["k"], vector=None).collect()}
    got = prep.preprocess_apply(unseen, fitted, keep=["k"])
    assert {r["k"]: r["features"].toArray().tolist() for r in got.collect()} == dense
    assert len(dense[0]) == len(fitted.feature_names())
