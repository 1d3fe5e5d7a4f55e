import numpy as np
from pyspark.sql import functions as F

from tabsleuth.functions import ranking as rk


def test_cumulative_equals_numpy(spark):
    rng = np.random.default_rng(1)
    vals = rng.integers(0, 500, 3000)
    grp = rng.integers(0, 3, 3000)
    df = spark.createDataFrame([(int(g), float(v)) for g, v in zip(grp, vals)], "g int, v double")
    freq = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("count"))
    cum = rk.cumulative_by_value(freq, ["g"], "v", ["count"]).toPandas()
    for g, part in cum.groupby("g"):
        part = part.sort_values("v")
        assert (part["cum_count"].to_numpy() == np.cumsum(part["count"].to_numpy())).all()
        assert (part["total_count"] == part["count"].sum()).all()


def test_cumulative_descending_and_strings(spark):
    df = spark.createDataFrame([(0, s) for s in ["b", "a", "d", "c", "a"]], "g int, s string").groupBy("g", "s").agg(F.count(F.lit(1)).alias("n"))
    out = {r["s"]: r["cum_n"] for r in rk.cumulative_by_value(df, ["g"], "s", ["n"]).collect()}
    assert out == {"a": 2, "b": 3, "c": 4, "d": 5}
    num = spark.createDataFrame([(0, 1.0, 1), (0, 2.0, 1), (0, 3.0, 2)], "g int, v double, n long")
    d = {r["v"]: r["cum_n"] for r in rk.cumulative_by_value(num, ["g"], "v", ["n"], descending=True).collect()}
    assert d == {3.0: 2, 2.0: 3, 1.0: 4}


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=2001)
    y = rng.integers(0, 20, 2001).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    probs = [0.1, 0.25, 0.5, 0.75, 0.9]
    q = {(r["column"], r["prob"]): r["value"] for r in rk.exact_quantiles(df, ["x", "y"], probs).collect()}
    for c, arr in (("x", x), ("y", y)):
        for p in probs:
            assert abs(q[(c, p)] - np.quantile(arr, p)) < 1e-9


def test_average_ranks_ties(spark):
    df = spark.createDataFrame([(0, 1.0, 1), (0, 2.0, 3), (0, 5.0, 1)], "g int, v double, count long")
    r = {row["v"]: row["rank"] for row in rk.average_ranks(df, ["g"], "v").collect()}
    assert r == {1.0: 1.0, 2.0: 3.0, 5.0: 5.0}


def test_null_groups_and_large_integers_keep_their_place(spark):
    big = 2**53
    df = spark.createDataFrame([(None, big + 1, 1), (None, big, 2), (1, 5, 3), (None, big + 2, 4)], "g int, v long, n long")
    got = {(r["g"], r["v"]): (r["cum_n"], r["total_n"]) for r in rk.cumulative_by_value(df, ["g"], "v", ["n"]).collect()}
    assert got == {(None, big): (2, 7), (None, big + 1): (3, 7), (None, big + 2): (7, 7), (1, 5): (3, 3)}


def test_one_group_spreads_over_tasks(spark):
    df = spark.range(20000).selectExpr("0 AS g", "id AS v", "1L AS n")
    out = rk.cumulative_by_value(df, ["g"], "v", ["n"])
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert out.where("cum_n != v + 1").count() == 0 and max(sizes) < 20000


def test_quantiles_unfold_only_values_at_wanted_places(spark):
    """Values that no probability asks for are left out before one row a
    probability is made of each value."""
    rng = np.random.default_rng(6)
    values = np.concatenate([rng.normal(size=400), np.full(200, 0.5), rng.integers(0, 4, 300)]).tolist()
    df = spark.createDataFrame([(v, None if i % 3 else -v) for i, v in enumerate(values)], "a double, b double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    got = {(r["column"], r["prob"]): r["value"] for r in rk.exact_quantiles(df, ["a", "b"], probs).collect()}
    for c, own in (("a", values), ("b", [-v for v in values[::3]])):
        for p, want in zip(probs, np.quantile(own, probs)):
            assert abs(got[c, p] - want) < 1e-9
    plan = rk._quantiles_from_freq(df, ["a", "b"], probs)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    unfold = next(i for i, line in enumerate(plan) if "Generate explode" in line)
    assert any("FLOOR" in line for line in plan[unfold + 1:])
