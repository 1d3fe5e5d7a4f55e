import math

import numpy as np
from pyspark.sql import functions as F

from tabsleuth.functions.stats import chi2_survival, f_survival
from tabsleuth.operators import relations as rl

from conftest import SF001


def test_cramers_v_yates_on_2x2(spark):
    rows = [("a", "x")] * 10 + [("a", "y")] * 5 + [("b", "x")] * 3 + [("b", "y")] * 12
    df = spark.createDataFrame(rows, "p string, q string")
    chi = rl.chi_square_test(df).first()
    # Yates-corrected chi2 of [[10, 5], [3, 12]]
    obs = np.array([[10, 5], [3, 12]], dtype=float)
    exp = obs.sum(1)[:, None] * obs.sum(0)[None, :] / obs.sum()
    d = np.abs(obs - exp)
    expected = (((d - np.minimum(0.5, d)) ** 2) / exp).sum()
    assert abs(chi["chi2"] - expected) < 1e-12
    v = rl.cramers_v(df, "p", "q").first()["value"]
    assert abs(v - math.sqrt(expected / 30)) < 1e-12


def test_chi_square_with_empty_cells(spark):
    rows = [("a", "x")] * 4 + [("b", "y")] * 4 + [("c", "z")] * 2 + [("a", "y")]
    df = spark.createDataFrame(rows, "p string, q string")
    chi = rl.chi_square_test(df).first()["chi2"]
    obs = np.zeros((3, 3))
    for a, b in rows:
        obs["abc".index(a), "xyz".index(b)] += 1
    exp = obs.sum(1)[:, None] * obs.sum(0)[None, :] / obs.sum()
    assert abs(chi - ((obs - exp) ** 2 / exp).sum()) < 1e-9


def _kendall_brute(x, y):
    n = len(x)
    s = n1 = n2 = 0
    for i in range(n):
        for j in range(i + 1, n):
            s += np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])
            n1 += x[i] == x[j]
            n2 += y[i] == y[j]
    n0 = n * (n - 1) / 2
    return s / math.sqrt((n0 - n1) * (n0 - n2))



def test_kendall_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 15, 300).astype(float)
    y = (x + rng.integers(0, 8, 300)).astype(float)
    y[::17] = np.nan
    df = spark.createDataFrame([(float(a), None if np.isnan(b) else float(b)) for a, b in zip(x, y)], "x double, y double")
    got = rl.kendall(df, "x", "y").first()["value"]
    keep = ~np.isnan(y)
    assert abs(got - _kendall_brute(x[keep], y[keep])) < 1e-12


def test_spearman_pairwise_deletion(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 30, 400).astype(float)
    b = a * 0.5 + rng.normal(size=400)
    b[::7] = np.nan
    df = spark.createDataFrame([(float(u), None if np.isnan(v) else float(v)) for u, v in zip(a, b)], "a double, b double")
    got = rl.spearman(df).first()["value"]
    keep = ~np.isnan(b)
    import pandas as pd

    want = pd.Series(a[keep]).rank().corr(pd.Series(b[keep]).rank())
    assert abs(got - want) < 1e-12


def test_pearson_symmetric_range_and_constant(spark):
    li = spark.read.parquet(f"{SF001}/lineitem.parquet").withColumn("k", F.lit(1.0))
    rows = rl.pearson(li, ["l_quantity", "l_extendedprice", "l_tax", "k"]).collect()
    for r in rows:
        if "k" in (r["var1"], r["var2"]):
            assert r["value"] is None
        else:
            assert -1 <= r["value"] <= 1
    again = {(r["var1"], r["var2"]): r["value"] for r in rl.pearson(li.repartition(7), ["l_quantity", "l_extendedprice"]).collect()}
    first = {(r["var1"], r["var2"]): r["value"] for r in rows if (r["var1"], r["var2"]) in again}
    assert abs(again[("l_quantity", "l_extendedprice")] - first[("l_quantity", "l_extendedprice")]) < 1e-12


def test_anova_guards(spark):
    one_group = spark.createDataFrame([(float(i), "g") for i in range(20)], "x double, c string")
    assert rl.anova_f(one_group, ["x"], ["c"]).count() == 0
    assert rl.anova_f_score(one_group, "x", "c").first()["f_statistic"] == 0.0
    few = spark.createDataFrame([(float(i), "ab"[i % 2]) for i in range(9)], "x double, c string")
    assert rl.anova_f(few, ["x"], ["c"]).count() == 0


def test_distribution_tails_against_tables():
    # F(2, 10) critical value at .05 is 4.1028; chi2(1) at .05 is 3.8415
    assert abs(f_survival(4.102821, 2, 10) - 0.05) < 1e-5
    assert abs(f_survival(2.866081, 4, 20) - 0.05) < 1e-5
    assert abs(f_survival(2.710890, 5, 20) - 0.05) < 1e-5
    assert abs(chi2_survival(3.841459, 1) - 0.05) < 1e-6
    assert abs(chi2_survival(18.307038, 10) - 0.05) < 1e-6


def test_mi_nonnegative_and_zero_for_independent(spark):
    rows = [(a, b) for a in "xyz" for b in "pq" for _ in range(10)]
    df = spark.createDataFrame(rows, "a string, b string")
    mi = rl.pairwise_mi(df).first()["value"]
    assert abs(mi) < 1e-12
    dep = spark.createDataFrame([(a, a) for a in "xyzw" for _ in range(5)], "a string, b string")
    assert abs(rl.pairwise_mi(dep).first()["value"] - math.log(4)) < 1e-12


def test_vif_against_least_squares(spark):
    rng = np.random.default_rng(11)
    x1 = rng.normal(5, 1, 200)
    x2 = x1 * 0.8 + rng.normal(0, 0.5, 200)
    x3 = rng.normal(-2, 2, 200)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x1, x2, x3)], "x1 double, x2 double, x3 double")
    got = {r["feature"]: r["vif"] for r in rl.vif(df).collect()}
    X = np.column_stack([x1, x2, x3])
    for i, name in enumerate(["x1", "x2", "x3"]):
        others = np.delete(X, i, axis=1)
        coef, *_ = np.linalg.lstsq(others, X[:, i], rcond=None)
        rss = ((X[:, i] - others @ coef) ** 2).sum()
        r2 = 1 - rss / (X[:, i] ** 2).sum()  # uncentred, no intercept
        assert abs(got[name] - 1 / (1 - r2)) < 1e-6 * got[name]


def test_kendall_pairs_batch_matches_single(spark):
    rng = np.random.default_rng(9)
    a = rng.integers(0, 10, 200).astype(float)
    b = (a + rng.integers(0, 5, 200)).astype(float)
    c = rng.normal(size=200).round(1)
    df = spark.createDataFrame([(float(x), float(y), float(z)) for x, y, z in zip(a, b, c)], "a double, b double, c double")
    got = {(r["var1"], r["var2"]): r["value"] for r in rl.kendall_pairs(df, [("a", "b"), ("a", "c"), ("b", "c")]).collect()}
    for (x, y), arr in {("a", "b"): (a, b), ("a", "c"): (a, c), ("b", "c"): (b, c)}.items():
        assert abs(got[(x, y)] - _kendall_brute(*arr)) < 1e-12


def test_kendall_over_many_blocks(spark, monkeypatch):
    """Ties, a value of a third of the rows, holes, infinities and both zeros,
    with cuts that leave several values or one in a block."""
    from tabsleuth.functions import blocks

    rng = np.random.default_rng(12)
    n = 400
    a = np.where(rng.random(n) < 0.35, 0.0, rng.normal(size=n).round(2))
    b = (a + rng.normal(size=n)).round(1)
    c = rng.integers(0, 3, n).astype(float)
    d = rng.permutation(n).astype(float)
    a[:3], b[5:8] = (-0.0, np.inf, np.inf), np.inf
    b[::11], d[::13] = np.nan, np.nan
    frame = {"a": a, "b": b, "c": c, "d": d}
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in zip(*frame.values())], "a double, b double, c double, d double").repartition(3)
    for size in (7, 90, 10**6):
        monkeypatch.setattr(blocks, "BLOCK_ROWS", size)
        got = {(r["var1"], r["var2"]): r["value"] for r in rl.kendall_matrix(df).collect()}
        assert len(got) == 6
        for (x, y), value in got.items():
            keep = ~np.isnan(frame[x]) & ~np.isnan(frame[y])
            finite = [np.nan_to_num(frame[v][keep], posinf=1e9) for v in (x, y)]
            assert abs(value - _kendall_brute(*finite)) < 1e-12


def test_kendall_forms_no_cells_of_wide_columns(spark, monkeypatch):
    """Rows are dealt out once a column; distinct value pairs are not expanded."""
    monkeypatch.setattr(rl, "numeric_cells", lambda *a: 1 / 0)
    df = spark.range(500).selectExpr("id AS x", "id * 7 % 500 AS y", "cast(null as double) AS z", "1 AS one")
    got = {(r["var1"], r["var2"]): r["value"] for r in rl.kendall_matrix(df).collect()}
    x = np.arange(500)
    assert abs(got[("x", "y")] - _kendall_brute(x, x * 7 % 500)) < 1e-12
    assert all(v is None for p, v in got.items() if p != ("x", "y"))


def test_concordant_pairs_and_ties():
    from tabsleuth.functions import blocks

    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 127, 128, 129, 700):
        x, y = rng.integers(0, 40, n).astype(float), rng.integers(0, 60, n).astype(float)
        assert blocks.concordant(x, y) == ((x[:, None] < x[None]) & (y[:, None] < y[None])).sum()
        assert blocks.ties(x, y) == (((x[:, None] == x[None]) & (y[:, None] == y[None])).sum() - n) // 2


def test_spearman_ranks_without_a_sort_or_cells(spark, monkeypatch):
    """Columns with and without missing values, ranked in blocks of their values."""
    import pandas as pd

    from tabsleuth.functions import blocks

    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"a": np.where(rng.random(300) < 0.4, 0.0, rng.normal(size=300)), "b": rng.integers(0, 4, 300) * 1.0, "c": rng.normal(size=300), "d": rng.normal(size=300)})
    frame.loc[::7, "d"] = np.nan
    frame.loc[:2, "c"] = [np.inf, np.inf, -np.inf]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in frame.to_numpy()], "a double, b double, c double, d double").repartition(3)
    monkeypatch.setattr(rl, "_ranked_long", lambda *a: 1 / 0)
    monkeypatch.setattr(rl, "numeric_cells", lambda *a: 1 / 0)
    for size in (40, 10**6):
        monkeypatch.setattr(blocks, "BLOCK_ROWS", size)
        got = {(r["var1"], r["var2"]): r["value"] for r in rl.spearman(df).collect()}
        assert len(got) == 6
        for (x, y), value in got.items():
            ranks = frame[[x, y]].dropna().rank()
            assert abs(value - ranks[x].corr(ranks[y])) < 1e-12
    monkeypatch.undo()
    monkeypatch.setattr(rl, "RANK_PASSES", 0)
    again = {(r["var1"], r["var2"]): r["value"] for r in rl.spearman(df).collect()}
    assert all(abs(again[p] - v) < 1e-12 for p, v in got.items())
