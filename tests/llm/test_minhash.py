import random

import numpy as np
import pytest
from helpers import ODD_TEXTS, components, documents, prose, shingles

from tabsleuth.llm import minhash as mh


def corpus():
    rnd = random.Random(8)
    texts = list(ODD_TEXTS) + [None, "TWO words", "two  WORDS"]
    for g in range(6):
        base = prose(300 + g, 80).split()
        texts.append(" ".join(base))
        for _ in range(8):  # copies with some words changed: similarity on either side of the limit
            copy = list(base)
            for _ in range(rnd.randrange(1, 5)):
                copy[rnd.randrange(len(copy))] = f"new{rnd.randrange(10**6)}"
            texts.append(" ".join(copy))
        texts.append(" ".join(base).upper())
    passage = prose(400, 60)
    return texts + [f"{passage} {prose(500 + i, 8 + i)}" for i in range(30)]


def brute(texts):
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    root = components(range(len(texts)), links)
    return {i: (len(sets[i]), root[i], root[i] == i) for i in range(len(texts))}


@pytest.mark.parametrize("small", [False, True])
def test_components_equal_brute_force(spark, small, monkeypatch):
    if small:  # frequencies by broadcast as well, and lists split into blocks
        monkeypatch.setattr(mh, "HOT_LEAST", 4)
        monkeypatch.setattr(mh, "BLOCK", 2)
    texts = corpus()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in mh.near_duplicates(documents(spark, texts)).collect()}
    assert got == brute(texts)


@pytest.mark.parametrize("small", [False, True])
def test_no_collision_of_signatures_is_missed(spark, small, monkeypatch):
    """Every two signatures with enough equal coordinates are connected, whatever
    values all others share, and only candidates connect."""
    if small:
        monkeypatch.setattr(mh, "HOT_LEAST", 4)
        monkeypatch.setattr(mh, "BLOCK", 4)
    rng = np.random.default_rng(5)
    sig = rng.integers(0, 1 << 32, (120, mh.COORDS), dtype=np.uint32)
    sig[:60, :33] = sig[0, :33]  # one passage in half of all, one short of a candidate
    for i in range(0, 120, 3):  # pairs on either side of the limit
        same = rng.permutation(mh.COORDS)[: mh.MATCHES - 3 + (i // 3) % 6]
        sig[i + 1, same] = sig[i, same]
    n = rng.integers(75, 101, 120)
    rows = spark.createDataFrame([(i, int(n[i]), bytearray(sig[i].tobytes())) for i in range(120)], "id long, n long, sig binary").repartition(5)
    found = [(r["a"], r["b"]) for r in mh.candidate_links(rows).collect()]
    a, b = np.triu_indices(120, 1)
    alike = 100 * np.minimum(n[a], n[b]) >= 75 * np.maximum(n[a], n[b])
    true = alike & ((sig[a] == sig[b]).sum(axis=1) >= mh.MATCHES)
    low = sig.astype(np.uint8)
    root = components(range(120), found)
    assert true.sum() > 20 and all(root[i] == root[j] for i, j in zip(a[true], b[true], strict=True))
    assert all((low[i] == low[j]).sum() >= mh.MATCHES and 100 * min(n[i], n[j]) >= 75 * max(n[i], n[j]) for i, j in found)


def test_pairs_beside_a_passage_that_all_texts_share(spark):
    """Links between texts that share half to two thirds of their words with all others."""
    rnd, texts = random.Random(3), []
    passage = prose(900, 200)
    for i in range(80):
        own = prose(1000 + i, 100 + 100 * (i % 2)).split()
        copy = list(own)
        for _ in range(6):
            copy[rnd.randrange(len(copy))] = f"new{rnd.randrange(10**6)}"
        texts += [f"{passage} {' '.join(own)}", f"{passage} {' '.join(copy)}"]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in mh.near_duplicates(documents(spark, texts)).collect()}
    want = brute(texts)
    assert len({v[1] for v in want.values()}) > 40 and got == want


def test_one_row_of_each_group_stays(spark):
    texts = corpus()
    df = documents(spark, texts)
    out = mh.drop_near_duplicates(df.unionByName(df.where("doc_id = 15")))
    assert out.columns == df.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(i for i, v in brute(texts).items() if v[2])


def test_equal_and_null_ids(spark):
    a, b = prose(1, 30), prose(2, 30)
    df = spark.createDataFrame([(1, a), (1, b), (2, a), (None, b), (None, prose(3, 9)), (3, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in mh.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 26, 1, True), (1, 26, 1, True), (2, 26, 1, False), (None, 26, 1, False), (None, 5, None, False), (3, 0, 3, True)], key=str)
    assert len(mh.drop_near_duplicates(df).collect()) == 4
    assert mh.near_duplicates(df.limit(0)).collect() == [] and mh.drop_near_duplicates(df.limit(0)).collect() == []


def test_skipping_never_loses_a_candidate():
    rng = np.random.default_rng(0)
    low = rng.integers(0, 2, (60, mh.COORDS), dtype=np.uint8)
    a, b = np.triu_indices(60, 1)
    full = (low[a] == low[b]).sum(axis=1)
    assert ((mh._collisions(low, a, b) >= mh.MATCHES) == (full >= mh.MATCHES)).all()


def test_the_prefix_skips_pairs_and_only_those_that_cannot_match():
    low = np.zeros((mh.COORDS + 2, mh.COORDS), dtype=np.uint8)
    for k in range(mh.COORDS + 1):  # agrees with the first on its last k coordinates
        low[k + 1, : mh.COORDS - k] = 1
    other = np.arange(1, mh.COORDS + 2)
    count = mh._collisions(low, np.zeros_like(other), other)
    true = other - 1
    assert (count[true >= mh.MATCHES] == true[true >= mh.MATCHES]).all()
    assert (count[(true > 0) & (true < mh.MATCHES)] == 0).any()
