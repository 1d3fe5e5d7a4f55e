"""A bounded memo for per-word results inside Python workers."""

from __future__ import annotations


class WordCache:
    """Memo word -> value with bounded memory: two generations of about
    ``limit`` words each; ``compute`` maps a list of words to their values. When the young one is full it becomes the old one;
    a word found in the old one moves back to the young one. The result never
    depends on what the memo holds, only the time does."""

    def __init__(self, compute, limit: int = 200_000, longest: int = 64):
        self.compute, self.limit, self.longest = compute, limit, longest
        self.young: dict = {}
        self.old: dict = {}

    def many(self, words: list) -> list:
        """Values of the words of a text."""
        out = list(map(self.young.get, words))
        if None in out:
            self.fill([(out, words)])
        return out

    def fill(self, holes: list[tuple[list, list]]) -> None:
        """Complete lists of values (None: not in the young generation) whose
        words are given beside them; what is missing is computed in one call."""
        old, found, missing = self.old, {}, []
        for out, words in holes:
            for i, v in enumerate(out):
                if v is None and (w := words[i]) not in found:
                    if (v := old.get(w)) is None:
                        missing.append(w)
                    found[w] = v
        if missing:
            found.update(zip(missing, self.compute(missing), strict=True))
        for out, words in holes:
            for i, v in enumerate(out):
                if v is None:
                    out[i] = found[words[i]]
        self.keep(found)

    def keep(self, found: dict) -> None:
        """Take values up; longer words are rare and large, and left out."""
        if len(self.young) + len(found) > self.limit:
            self.old, self.young = self.young, {}
        longest = self.longest
        self.young.update((w, v) for w, v in found.items() if len(w) <= longest)
