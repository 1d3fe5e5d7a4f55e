"""Fixture texts and plain reference versions for the tests of the llm operators."""

from __future__ import annotations

import random
import re

TOKENS = ["alpha", "Beta", "gamma,", "delta", "épsilon", "zeta.", "eta", "theta", "iota", "kappa", "lambda", "mu"]

#: every operator on documents must take these rows
ODD_TEXTS = [None, "", " ", "\n\t", "one", "two words", "  lead and trail  ", "née été ÀÉ", "<|endoftext|> x <|startoftext|>", "日本語 テキスト 🙂", "a" * 5000, "ab " * 900]


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join(rnd.choice(TOKENS) + str(rnd.randrange(40)) for _ in range(n))


def documents(spark, texts, **more):
    """doc_id, text and columns whose names are those used inside operators."""
    rows = [(i, t, "en", "src0", len(t or ""), "x", 1, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, class string, count int, row string")


def shingles(text: str | None) -> frozenset:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def components(nodes, linked) -> dict:
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
