"""Co-moments in one scan and ranks in one sort, against numpy and pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsleuth.functions import moments
from tabsleuth.operators import relations


def wide_table(spark, n=300, p=14, holes=0.1, apart=1e6):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, p)) @ rng.normal(size=(p, p)) + apart * np.arange(p)
    x[:, 3] = 7.0  # constant
    x[:, 4] = np.round(x[:, 4])  # ties
    x[rng.random((n, p)) < holes] = np.nan
    x[:, 5] = np.nan  # nothing there
    x[:, 6] = 2 * x[:, 7]
    frame = pd.DataFrame(x, columns=[f"a.{i}" for i in range(p)])
    return spark.createDataFrame(frame).repartition(5), frame


@pytest.mark.parametrize("holes", [0.0, 0.3])
def test_pearson_of_a_wide_table_takes_one_scan(spark, holes, monkeypatch):
    df, frame = wide_table(spark, holes=holes)
    monkeypatch.setattr(moments, "BLOCK_VALUES", 200)
    monkeypatch.setattr(moments, "FAN_IN", 2)
    want = frame.corr(min_periods=2)
    got = {(r["var1"], r["var2"]): r["value"] for r in relations.pearson(df).collect()}
    assert len(got) == 14 * 13 // 2
    for (a, b), v in got.items():
        w = want.loc[a, b]
        assert v is None if pd.isna(w) else v == pytest.approx(w, abs=1e-9)


def test_both_ways_of_pearson_agree(spark, monkeypatch):
    df, _ = wide_table(spark)
    some = df.columns[:8]
    narrow = {(r[0], r[1]): r[2] for r in relations.pearson(df, some).collect()}
    monkeypatch.setattr(moments, "NARROW", 0)
    for r in relations.pearson(df, some).collect():
        assert (r[2] is None) == (narrow[(r[0], r[1])] is None)
        assert r[2] is None or r[2] == pytest.approx(narrow[(r[0], r[1])], abs=1e-9)


def test_vif_of_a_wide_table(spark):
    df, frame = wide_table(spark, holes=0.0, apart=3)
    got = {r["feature"]: r["vif"] for r in relations.vif(df).collect()}
    x = frame.drop(columns=["a.3", "a.5"])
    assert set(got) == set(x.columns)
    assert got["a.6"] == got["a.7"] == float("inf")
    rest = x.drop(columns=["a.6"]).to_numpy()
    for i, c in enumerate(x.drop(columns=["a.6"]).columns):
        if c != "a.7":
            others = np.delete(rest, i, axis=1)
            resid = rest[:, i] - others @ np.linalg.lstsq(others, rest[:, i], rcond=None)[0]
            assert got[c] == pytest.approx((rest[:, i] ** 2).sum() / (resid**2).sum(), rel=1e-3)


def test_co_moments_of_no_rows(spark):
    df = spark.createDataFrame([], "a double, b double")
    assert moments.co_moments(df, [F.col("a"), F.col("b")])[(0, 1)]["n"] == 0


def test_ranks_with_values_over_many_ranges(spark):
    rng = np.random.default_rng(6)
    frame = pd.DataFrame({
        "same": np.full(400, 2.5),
        "hot": np.where(rng.random(400) < 0.4, 0.0, rng.normal(size=400)),
        "few": rng.integers(0, 3, 400).astype(float),
        "plain": rng.normal(size=400),
    })
    rows = relations.ranked_rows(spark.createDataFrame(frame).repartition(4), list(frame.columns)).toPandas()
    want = frame.rank(method="average")
    for i, c in enumerate(frame.columns):
        assert sorted(rows[f"r{i}"]) == sorted(want[c])
    key = ["r1", "r3"]
    pairs = pd.DataFrame({"r1": want["hot"], "r3": want["plain"], "r2": want["few"]})
    assert rows[[*key, "r2"]].sort_values(key).to_numpy().tolist() == pairs[[*key, "r2"]].sort_values(key).to_numpy().tolist()
