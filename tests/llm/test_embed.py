import math

import numpy as np
import pytest
from helpers import components

from tabsleuth.llm import embed_dedup as ed


def vectors():
    rng = np.random.default_rng(4)
    rows = [rng.standard_normal(16) for _ in range(120)]
    for size, noise in ((12, 0.05), (30, 0.2), (25, 0.33)):  # the last: similarities on either side of the limit
        base = rng.standard_normal(16)
        rows += [base + noise * rng.standard_normal(16) for _ in range(size)]
    rows += [rows[0]] * 3 + [rows[1] * 7.0]
    out = [[float(x) for x in np.float32(r)] for r in rows]
    return out + [None, [], [0.0] * 16, [1.0, None] + [0.0] * 14, [math.nan] + [1.0] * 15, [math.inf] * 16, [1.0, 2.0], [2.0, 4.0], [-0.0, 1.0], [0.0, 1.0]]


def brute(rows):
    unit = {}
    for i, v in enumerate(rows):
        if v and None not in v and all(map(math.isfinite, v)) and any(v):
            x = np.array(v)
            unit[i] = x / np.linalg.norm(x)
    links = [(i, j) for i in unit for j in unit if j < i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9]
    root = components(range(len(rows)), links)
    return {i: (sum(i in p for p in links), root[i], root[i] == i) for i in range(len(rows))}


@pytest.mark.parametrize(("group", "window"), [(2048, 128), (4, 128), (4, 6)])
def test_links_equal_brute_force(spark, group, window, monkeypatch):
    monkeypatch.setattr(ed, "BLOCK", 8)
    rows = vectors()
    df = spark.createDataFrame([(i, v, i, "c") for i, v in enumerate(rows)], "vec_id long, embedding array<float>, label int, class string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in ed.near_duplicate_vectors(df, window=window, group=group).collect()}
    want = brute(rows)
    if window > len(rows) / 2:
        assert got == want
    else:  # few neighbours a pass: components may miss a link, none may be invented
        assert all(got[i][0] <= want[i][0] for i in want) and sum(got[i][0] for i in want) >= 0.95 * sum(v[0] for v in want.values())


def test_doubles_equal_ids_null_ids_empty_table(spark):
    df = spark.createDataFrame([(1, [1.0, 1e-9]), (1, [1.0, 0.0]), (None, [2.0, 0.0]), (5, [0.0, 1.0]), (None, None)], "vec_id long, embedding array<double>")
    got = sorted((tuple(r) for r in ed.near_duplicate_vectors(df).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (5, 0, 5, True), (None, 0, None, True)], key=str)
    assert ed.near_duplicate_vectors(df.limit(0)).collect() == []


def test_passes_grow_slowly():
    assert [ed.n_passes(n) for n in (0, 100, 50_000)] == [1, 1, 16] and ed.n_passes(10**9) < 200


def dense(n=6000, dim=64):
    """A third of the vectors at a cosine of about .75 to each other, half of
    them and of the others with a partner just above the limit."""
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    middle = unit(rng.standard_normal((1, dim)))
    hot = np.sqrt(0.75) * middle + np.sqrt(0.25) * unit(rng.standard_normal((n // 4, dim)))
    cold = rng.standard_normal((n // 2, dim))
    base = unit(np.concatenate((hot, cold)))
    own = np.r_[0 : n // 12, n // 4 : n // 4 + n // 6]
    side = rng.standard_normal((len(own), dim))
    side = unit(side - (side * base[own]).sum(axis=1, keepdims=True) * base[own])
    cos = rng.uniform(0.9005, 0.91, (len(own), 1))
    return np.float32(np.concatenate((base, cos * base[own] + np.sqrt(1 - cos**2) * side)))


def test_links_in_a_dense_group_that_is_not_linked(spark):
    rows = dense()
    unit = rows.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")
    got = np.array([r["n_links"] for r in ed.near_duplicate_vectors(df).orderBy("vec_id").collect()])
    hot = np.r_[0:1500, 4500:5000]
    assert (got <= want).all() and want[hot].sum() > 900
    assert got.sum() >= 0.99 * want.sum() and got[hot].sum() >= 0.99 * want[hot].sum(), (got.sum() / want.sum(), got[hot].sum() / want[hot].sum())
