import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsleuth.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, chunk string, slab int, id string, rank double"


def brute(rows, every, scale=256.0):
    seen = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if i not in seen or (label, v) < seen[i]:
            seen[i] = (label, v)
    whole = {i: (label, [math.floor(scale * x) for x in v]) for i, (label, v) in seen.items()}
    out = set()
    for a, (label, q) in whole.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(q, w, strict=False)) for i, (_, w) in whole.items() if i != a}
        best = sorted((i for i in score if whole[i][0] == label), key=lambda i: (-score[i], i))[:5]
        for p in best:
            fits = [i for i in score if whole[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            for rank, n in enumerate(sorted(fits, key=lambda i: (-score[i], i))[:3], 1):
                out.add((a, p, rank, n, score[p], score[n]))
    return out


def mined(spark, rows, every):
    df = spark.createDataFrame([(*r, "x", 1, "y", 0.5) for r in rows], SCHEMA)
    got = hn.hard_negatives(df, F.col("vec_id") % every == 0).collect()
    found = {(r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got}
    assert len(found) == len(got)
    return found


def vectors(seed, n, dim=8, labels=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(4, dim))
    return [(i, (middle[i % 4] + rng.normal(size=dim) * 0.3).round(2).tolist(), int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize(("slab", "chunk"), [(4096, 8192), (7, 40)])
def test_equal_to_brute_force(spark, monkeypatch, slab, chunk):
    monkeypatch.setattr(hn, "SLAB", slab)
    monkeypatch.setattr(hn, "CHUNK", chunk)
    rows = vectors(1, 150)
    rows += [(150 + i, [1.0] * 8, i % 3) for i in range(40)]  # equal vectors, ties by id
    assert mined(spark, rows, 5) == brute(rows, 5)


def test_odd_rows(spark):
    rows = vectors(2, 40)
    rows += [(40, None, 1), (45, [float("nan")] * 8, 1), (50, [1.0, None], 1), (55, [float("inf")] * 8, 2), (None, [1.0] * 8, 1), (60, [1.0] * 8, None)]
    rows += [(65, [0.0] * 8, 1), (66, [0.0] * 8, 2), (70, [1.5, -2.0], 1), (75, [], 0), (80, [-1.0] * 8, 1)]
    rows += rows[:7] + [(5, [9.0] * 8, 0), (5, [0.5] * 8, 0)]  # repeated rows, one id with several vectors
    assert mined(spark, rows, 5) == brute(rows, 5)
    assert mined(spark, [], 5) == set()
    assert mined(spark, rows[:1], 5) == set()


def test_large_components_are_exact(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.uniform(-2e5, 2e5) for _ in range(6)], i % 2) for i in range(60)]
    assert mined(spark, rows, 10) == brute(rows, 10)


def test_bounds_hold_and_spare_rows():
    rng = np.random.default_rng(4)
    x = np.floor(256 * rng.normal(size=(500, 16)))
    anchors = np.floor(256 * (rng.normal(size=16) + 0.05 * rng.normal(size=(60, 16))))
    order, parent, edge = hn.spanning_tree(anchors)
    assert sorted(order.tolist()) == list(range(60)) and (parent < 0).sum() == 1
    place = {v: k for k, v in enumerate(order)}
    assert all(place[parent[v]] < place[v] for v in order[1:])
    bounds = hn.Bounds(hn.Rows(x, float(np.abs(anchors).max())), np.arange(500))
    for v in order:
        bounds.enter(v, parent[v], edge[v], float(np.linalg.norm(anchors[v])), False)
        exact = x @ anchors[v]
        assert (bounds.low[v] <= exact).all() and (exact <= bounds.high[v]).all()
        need = np.arange(500) if parent[v] < 0 else np.flatnonzero(bounds.high[v] >= hn._kth(bounds.low[v], 5))
        assert set(np.argsort(-exact, kind="stable")[:5]) <= set(need)
        bounds.rescore(v, anchors[v], need)
    assert bounds.rescored < 60 * 500 / 2
