import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import ODD_TEXTS, documents, prose

from tabsleuth.llm import suffix_dedup as sd


def test_two_stage_sort_equals_a_plain_sort():
    rnd = random.Random(3)
    for _ in range(200):
        letters = rnd.choice([1, 2, 3, 26])
        text = np.array([97 + rnd.randrange(letters) for _ in range(rnd.randrange(1, 300))], dtype=np.uint8)
        if rnd.random() < 0.5:
            text = np.concatenate([text, text[len(text) // 3 :], text])
        data = text.tobytes()
        assert sd.two_stage_suffix_array(text, 2000).tolist() == sorted(range(len(data)), key=lambda i: data[i:])
        length = rnd.choice([3, 8, 13, 16])
        valid = np.arange(len(data)) <= len(data) - length
        count = Counter(data[i : i + length] for i in range(len(data) - length + 1))
        assert sd.repeated_starts(text, valid, length).tolist() == [bool(v) and count[data[i : i + length]] > 1 for i, v in enumerate(valid)]


def expected(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + length] for b in data for p in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 2, dtype=bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p + 1 : p + length + 1] = True
        kept = bytes(np.frombuffer(b, dtype=np.uint8)[~gone[1 : len(b) + 1]])
        out.append((len(b), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    shared, edge = prose(1, 60), prose(2, 25)
    base = prose(3, 150)
    texts = [*ODD_TEXTS, base, base, base.replace("theta", "THETA", 2), prose(4, 30) + shared, shared + prose(5, 40), prose(6, 10) + shared + prose(7, 10)]
    texts += [prose(100 + i, 12) + " " + edge + " " + prose(200 + i, 12) for i in range(25)]  # one passage, many contexts
    return texts + [("line of text that comes again and again\n") * 12, "x" * 700 + "é" * 150]


@pytest.mark.parametrize("group, least, keys", [(4096, 4096, 1 << 18), (3, 2, 1 << 18), (3, 2, 8)])
def test_removal_equals_brute_force(spark, group, least, keys, monkeypatch):
    """Also where anchors are cut, and keys dealt over parts, by small bounds."""
    monkeypatch.setattr(sd.repeated_windows, "__defaults__", (sd.LENGTH, sd.GRAM, group))
    monkeypatch.setattr(sd, "HOT_LEAST", least)
    monkeypatch.setattr(sd, "HOT_KEYS", keys)
    texts = corpus()
    got = {r["doc_id"]: tuple(r)[1:] for r in sd.removal_digests(documents(spark, texts)).collect()}
    for i, want in enumerate(expected(texts, 200)):
        assert got[i] == want, (i, texts[i])


def test_equal_ids_null_ids_empty_table(spark):
    text = prose(9, 80)
    n = len(text.encode())
    rows = spark.createDataFrame([(1, text), (1, text), (None, "short"), (None, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in sd.removal_digests(rows).collect())
    assert got == [(0, 0, 0), (0, 5, 0), (1, n, n), (1, n, n)]
    assert sd.removal_digests(rows.limit(0)).collect() == []


def test_texts_are_cut_and_columns_stay(spark):
    texts = corpus()
    df = documents(spark, texts)
    out = sd.remove_repeats(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(texts) and got[0]["text"] is None and got[0]["class"] == "x"
    digest = expected(texts, 200)
    for i, t in enumerate(texts):
        if t is not None and digest[i][1] == 0:
            assert got[i]["text"] == t
        elif t is not None and t.isascii():
            assert hashlib.sha256(got[i]["text"].encode()).hexdigest() == digest[i][3]
