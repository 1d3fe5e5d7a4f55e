"""Splitting of whole texts into the words that byte-pair merges stay within."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from ._cache import WordCache
from ._text import slices

# The word pattern of the byte-level vocabulary and that of the
# word-end vocabulary, as their public files define them. ``\s`` is written
# out as the White_Space property so that control characters 1C-1F are text.
_SPACE = r"\p{White_Space}"
#: the same property as a list of code points
_BLANKS = r"\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
BYTE_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|{_SPACE}+(?![^{_SPACE}])|{_SPACE}+"
WORD_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_SPACE}\p{{L}}\p{{N}}]+"


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in character -> byte, by the public rule of byte-level
    vocabularies: printable Latin-1 bytes stand for themselves, the others take
    the code points from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def load_vocabulary(path: str) -> dict:
    """The parts of a tokenizer file that encoding needs."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in spec["model"]["merges"]]
    return {
        "vocab": spec["model"]["vocab"],
        "merges": merges,
        "suffix": spec["model"].get("end_of_word_suffix") or "",
        "special": {t["content"]: t["id"] for t in spec["added_tokens"]},
    }


def special_splitter(special: dict[str, int]):
    """Pattern with one group that splits a text at its special strings (the
    library's default: they are tokens of their own, longest first)."""
    if not special:
        return None
    return regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")")


class BytePieces:
    """Ids of texts under the byte-level word pattern; ``encode(words)`` gives
    the ids of distinct words, as bytes of little-endian 32-bit numbers.

    A space before a character that is no white space always begins a word of
    the pattern, so texts can be cut there with a plain split, and each
    distinct piece of a slice of texts is looked at once. A piece of letters
    alone is one word (space and letters), one with a punctuation mark at its
    end is two; memos answer most of them. All other pieces are cut by the
    pattern, and so are texts with spaces before other white space."""

    #: marks that are a word of their own between letters and a space
    MARKS = ",.;:!?"
    #: bytes of text that are looked at together
    SLICE = 6 << 20

    def __init__(self, encode, special: dict[str, int], limit: int = 80_000):
        self.encode = encode
        self.find = regex.compile(BYTE_PATTERN).findall
        self.split = special_splitter(special)
        self.special = {s: i.to_bytes(4, "little") for s, i in special.items()}
        self.marks = dict(zip(self.MARKS, encode(list(self.MARKS)), strict=True))
        self.words = WordCache(encode, limit // 3)
        self.spaced = WordCache(None, limit)  # letters -> ids of a space and the letters

    def whole(self, text: str) -> bytes:
        """Ids of one text, by the pattern alone."""
        if self.split is None or not self.split.search(text):
            return b"".join(self.words.many(self.find(text)))
        out = []
        for k, part in enumerate(self.split.split(text)):
            out += [self.special[part]] if k % 2 else self.words.many(self.find(part))
        return b"".join(out)

    def after_space(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces, each with the space before it."""
        get, before, marks = self.spaced.young.get, self.spaced.old.get, self.marks
        out = list(map(get, pieces))
        found: dict[str, bytes | None] = {}
        later, others = [], []
        for i in [i for i, v in enumerate(out) if v is None]:
            piece = pieces[i]
            if piece.isalpha():
                found[piece] = before(piece)
                later.append((i, piece, b""))
            elif (tail := marks.get(piece[-1:])) is not None and (letters := piece[:-1]).isalpha():
                if (v := get(letters)) is not None:
                    out[i] = v + tail
                else:
                    if letters not in found:
                        found[letters] = before(letters)
                    later.append((i, letters, tail))
            else:
                others.append((i, self.find(" " + piece)))
        missing = [w for w, v in found.items() if v is None]
        if missing:
            found.update(zip(missing, self.encode([" " + w for w in missing]), strict=True))
        for i, letters, tail in later:
            out[i] = found[letters] + tail
        self.spaced.keep(found)
        for (i, _), v in zip(others, self._joined([w for _, w in others]), strict=True):
            out[i] = v
        return out

    def _joined(self, lists: list[list[str]]) -> list[bytes]:
        """Ids of each list of words."""
        out = [list(map(self.words.young.get, words)) for words in lists]
        self.words.fill([(o, w) for o, w in zip(out, lists, strict=True) if None in o])
        return [b"".join(o) for o in out]

    def many(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of a string column (null: none), in order."""
        size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        for i, j in slices(np.append(0, np.cumsum(size, dtype=np.int64)), self.SLICE):
            yield from self._slice(column.slice(i, j - i).fill_null(""))

    def _slice(self, texts: pa.Array) -> Iterator[np.ndarray]:
        slow = pc.match_substring_regex(texts, f" [{_BLANKS}]")
        for s in self.special:
            slow = pc.or_(slow, pc.match_substring(texts, s))
        fast = pc.split_pattern(texts.filter(pc.invert(slow)), " ")
        flat, cuts = fast.flatten(), fast.offsets.to_numpy() - fast.offsets[0].as_py()
        coded = flat.dictionary_encode()
        begin, key = cuts[:-1], coded.indices.to_numpy(zero_copy_only=False).copy()
        data = self.after_space(coded.dictionary.to_pylist())
        key[begin] = len(data) + np.arange(len(begin))  # the first piece of a text has no space before it
        data += self._joined([self.find(p) for p in flat.take(pa.array(begin)).to_pylist()])
        length = np.fromiter(map(len, data), dtype=np.int32, count=len(data)) // 4
        start = np.cumsum(length, dtype=np.int32) - length
        n = length[key]
        end = np.cumsum(n, dtype=np.int32)
        ids = np.frombuffer(b"".join(data), dtype="<i4")[np.repeat(start[key] - (end - n), n) + np.arange(end[-1] if len(end) else 0, dtype=np.int32)]
        bounds = np.append(0, end)[cuts]
        k = 0
        for row, is_slow in enumerate(slow.to_pylist()):
            if is_slow:
                yield np.frombuffer(self.whole(texts[row].as_py()), dtype="<i4")
            else:
                yield ids[bounds[k] : bounds[k + 1]]
                k += 1
