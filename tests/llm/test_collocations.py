import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from helpers import ODD_TEXTS

from tabsleuth.llm import collocations as co


def brute(rows, least, top):
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    f: dict[str, Counter] = {}
    for lang, text in rows:
        counts = f.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(fold)):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            counts.update(w[i : i + k] for k in range(1, 6) for i in range(len(w) - k + 1))
    out = {}
    for lang, counts in f.items():
        n = sum(c for p, c in counts.items() if len(p) == 1)
        cands = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        scored = []
        for p, a in cands.items():
            if any(len(q) > len(p) and cands[q] >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q in cands):
                continue
            score, _, l, r = min((1000 * a * n // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1):
            out[(lang, rank)] = (p.decode(), -a, l, r, n, -s)
    return out


def found(spark, rows, least, top):
    df = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], "lang string, text string, phrase string, n long, rank int, words string")
    got = co.collocations(df.repartition(3), least, top).collect()
    out = {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got}
    assert len(out) == len(got)
    return out


WORDS = ["the", "of", "The", "new", "york", "city", "é", "a\x01b", "a", "b", "日本", "x-y", "rare"]


def texts(seed, n):
    rnd = random.Random(seed)
    gap = [" ", " ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\x00 ", "\x1c "]
    return ["".join(rnd.choice(WORDS[: rnd.choice([3, 6, 13])]) + rnd.choice(gap) for _ in range(rnd.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("ranges", [200_000, 4])
def test_equal_to_brute_force(spark, monkeypatch, ranges):
    monkeypatch.setattr(co, "RANGE_ROWS", ranges)
    rows = [(lang, t) for k, lang in enumerate(["en", "de", None, "und"]) for t in texts(k, 60)]
    rows += [("en", "New York City is New York City, the the the the the the the")] * 12 + [("fr", "un deux trois quatre cinq six")] * 9
    want = brute(rows, 6, 40)
    assert found(spark, rows, 6, 40) == want
    assert any(v[1] >= 9 and k[0] == "fr" for k, v in want.items())


def test_odd_texts_and_an_empty_table(spark):
    rows = [("en", t) for t in ODD_TEXTS] * 2 + [(None, None)]
    assert found(spark, rows, 2, 2000) == brute(rows, 2, 2000)
    assert found(spark, [], 2, 10) == {}
    assert found(spark, rows, 10**6, 10) == {}


def test_a_full_bit_table_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(co, "TABLE_BITS", 64)
    rows = [("en", t) for t in texts(9, 80)]
    assert found(spark, rows, 5, 30) == brute(rows, 5, 30)


def test_products_beyond_64_bits_are_exact(spark):
    spark.sql("SELECT 1")
    big = 4 * 10**9
    got = spark.sql(f"SELECT (cast(1000 AS decimal(38, 0)) * {big}L * {big * 10}L) div (cast(3 AS decimal(38, 0)) * {big // 7}L) AS s").first()["s"]
    assert got == 1000 * big * big * 10 // (3 * (big // 7))


def test_words_of_a_slice():
    w = co.Words(pa.array(["A b", "", "c  d. e", "f"]), pa.array(["x", "x", "y", "x"]))
    assert bytes(w.text) == b"a b c d e f "
    assert w.joined.tolist() == [True, False, True, False, False, False]
    keys = w.keys(w.start.argsort()[:1], 2)
    assert keys.tolist() == co.phrase_keys(pa.array(["x"]), pa.array(["a b"])).tolist()
