from itertools import combinations

import numpy as np
import pytest
from helpers import ODD_TEXTS, documents, prose

from tabsleuth.llm import decontaminate as dc


def cases():
    items = [prose(900 + i, 20 + i).replace(",", "").replace(".", "") for i in range(6)]
    changed = items[1].split()
    changed[4] = changed[13] = "zzz"
    texts = [
        *ODD_TEXTS,
        f"{prose(1, 50).replace(chr(44), str()).replace(chr(46), str())} {items[0]} {prose(2, 5)}",
        f"{prose(3, 9).replace(chr(44), str()).replace(chr(46), str())} {' '.join(changed)}",
        items[2].upper().replace(" ", "\n - "),
        " ".join(items[3].split()[2:17]),
        " ".join(items[3].split()[:9]),  # too little to be evidence
        prose(4, 400),
        f"{items[4]} {items[5]} {items[4]}",
    ]
    n = len(ODD_TEXTS)
    return items, texts, {(n, 0), (n + 1, 1), (n + 2, 2), (n + 3, 3), (n + 6, 4), (n + 6, 5)}


@pytest.mark.parametrize("sent", [dc.SENT_TOKENS, 1])
def test_planted_passages_are_found(spark, sent):
    items, texts, want = cases()
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(90, None), (91, "too short"), (0, items[0])], "item_id long, text string")
    found = dc.contaminated_pairs(documents(spark, texts), bench, sent_tokens=sent).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want and len(found) == len(want)
    by = {(r["doc_id"], r["item_id"]): r for r in found}
    n = len(ODD_TEXTS)
    assert tuple(by[(n, 0)])[2:] == (20, 20, 50, 0) and tuple(by[(n + 1, 1)])[2:] == (19, 21, 9, 0)


def test_both_ways_give_the_same_rows(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    one, two = (sorted(map(tuple, dc.contaminated_pairs(docs, bench, sent_tokens=s).collect())) for s in (dc.SENT_TOKENS, 1))
    assert one == two and one


def test_clean_rows_stay_with_their_columns(spark):
    items, texts, want = cases()
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    df = documents(spark, texts)
    out = dc.remove_contaminated(df.unionByName(df.where("doc_id = 3")), bench)
    assert out.columns == df.columns
    left = sorted(r["doc_id"] for r in out.collect())
    assert left == sorted([*(set(range(len(texts))) - {d for d, _ in want}), 3])
    assert dc.remove_contaminated(df, bench.limit(0)).count() == len(texts)
    assert dc.contaminated_pairs(df.limit(0), bench).collect() == []


def test_every_accepted_segment_leaves_a_seed():
    """All placings in segments of up to 59 tokens, by their last window: the fewest
    substitutions without a seed are too many. A longer segment has a part like that."""
    span, need = dc.SPAN, dc.NEED
    seeded = [any(all(k in two for k in range(span) if w >> k & 1) for two in dc.IGNORED) for w in range(1 << span)]
    fewest = {w: bin(w).count("1") for w in range(1 << span) if not seeded[w]}
    for length in range(span, 60):
        for n in fewest.values():
            assert length - n < 4 * n or length - n < min(need, -(-4 * length // 5)), (length, n)
        after: dict = {}
        for w, n in fewest.items():
            for b in (0, 1):
                to = w >> 1 | b << (span - 1)
                if not seeded[to]:
                    after[to] = min(n + b, after.get(to, n + b))
        fewest = after


def accepted(text: list, item: list) -> int:
    """Most equal tokens of a segment that is evidence, every shift and segment tried."""
    best = 0
    for shift in range(-len(item) + 1, len(text)):
        same = [0 <= k + shift < len(text) and text[k + shift] == w for k, w in enumerate(item)]
        for i, j in combinations(range(len(item) + 1), 2):
            if sum(same[i:j]) * 5 >= 4 * (j - i) and i + shift >= 0 and j + shift <= len(text):
                best = max(best, sum(same[i:j]))
    return best if best >= (len(item) if len(item) < dc.SPAN else min(dc.NEED, -(-4 * len(item) // 5))) else 0


@pytest.mark.parametrize("sent", [dc.SENT_TOKENS, 1])
def test_against_brute_force_alignment(spark, sent, monkeypatch):
    monkeypatch.setattr(dc, "HOT_LEAST", 3)
    rnd = np.random.default_rng(7)
    items = {n: [f"w{n}x{k}" for k in range(n)] for n in (3, 7, 8, 9, 10, 11, 12, 15, 17, 24)}
    texts = []
    for n, item in items.items():
        few = [c for k in range(1, 3) for c in combinations(range(n), k)] if n in (10, 11) else []
        more = [tuple(rnd.choice(n, size=rnd.integers(0, min(n, 6)), replace=False)) for _ in range(30)]
        for gone in [*few, *more]:
            low, high = sorted(rnd.choice(n + 1, size=2, replace=False)) if len(texts) % 3 == 0 else (0, n)
            changed = [f"other{k}" if k in gone else w for k, w in enumerate(item)][low:high]
            texts.append(["head"] * int(rnd.integers(0, 3)) + changed + ["tail"] * int(rnd.integers(0, 3)))
    want = {(d, n, m) for d, text in enumerate(texts) for n, item in items.items() if (m := accepted(text, item))}
    bench = spark.createDataFrame([(n, " ".join(item)) for n, item in items.items()], "item_id long, text string")
    found = dc.contaminated_pairs(documents(spark, [" ".join(t) for t in texts]), bench, sent_tokens=sent).collect()
    assert sorted(tuple(r)[:3] for r in found) == sorted(want)


def test_frequent_seeds_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(dc, "HOT_LEAST", 4)
    common = prose(50, 30)
    texts = [f"{prose(k, 20)} {common} {prose(k + 500, 3)}" for k in range(60)] + [prose(77, 4000) + " " + common, None, ""]
    bench = spark.createDataFrame([(1, common), (1, common + " and more"), (None, common), (2, prose(77, 4000)), (3, None)], "item_id long, text string")
    one, two = (dc.contaminated_pairs(documents(spark, texts), bench, sent_tokens=s).collect() for s in (dc.SENT_TOKENS, 1))
    assert sorted(map(repr, one)) == sorted(map(repr, two)) and len(one) == 61 * 2 + 1


@pytest.mark.parametrize("sent", [dc.SENT_TOKENS, 1])
def test_any_one_or_two_substitutions_in_an_item(spark, sent):
    items = {n: [f"w{n}x{k}" for k in range(n)] for n in range(13, 21)}
    texts, want = [], []
    for n, item in items.items():
        for i in range(n):
            for j in range(i, n):
                changed = [f"other{k}" if k in (i, j) else w for k, w in enumerate(item)]
                texts.append(" ".join(["before it", *changed, "after it"]))
                want.append((len(want), n, n - len({i, j})))
    bench = spark.createDataFrame([(n, " ".join(item)) for n, item in items.items()], "item_id long, text string")
    found = dc.contaminated_pairs(documents(spark, texts), bench, sent_tokens=sent).collect()
    assert sorted(tuple(r)[:3] for r in found) == want


@pytest.mark.parametrize("sent", [dc.SENT_TOKENS, 1])
def test_items_shorter_than_a_seed_match_whole(spark, sent):
    items = ["Solo", "Two words", "a b c d e f g", "one wordy end", "x", "", "two  WORDS!"]
    texts = ["solo", "lone two words, two words", "A, b c d e f g h solo", "a b c d z f g", "one wordy", "solos twowords", "one wordy end", None, "", "two", "words two"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = dc.contaminated_pairs(documents(spark, texts), bench, sent_tokens=sent).collect()
    assert sorted(map(tuple, found)) == [(0, 0, 1, 1, 0, 0), (1, 1, 2, 2, 1, 0), (1, 6, 2, 2, 1, 0), (2, 0, 1, 1, 8, 0), (2, 2, 7, 7, 0, 0), (6, 3, 3, 3, 0, 0)]
