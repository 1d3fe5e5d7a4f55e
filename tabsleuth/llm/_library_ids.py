"""Ids of whole texts by the tokenizers library, each distinct piece encoded once.

A space before a character that is no white space always begins a word of the
byte-level pattern, and words are encoded apart from each other. So a text may
be cut there into pieces, and the ids of a piece (with the space before it) do
not depend on its neighbours. Splitting, finding distinct pieces and putting
ids together are Arrow kernels over a slice of texts, and a bounded memo keeps
the ids of pieces. Those that it does not hold are joined to one text for the
library, whose ids are cut again before every token that begins with the space.
Texts with special strings, or with a space before other white space, go to the
library whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._pretokens import _BLANKS
from ._text import byte_column, slices

#: bytes of text that are looked at together
SLICE = 8 << 20
#: pieces that the memo holds before it starts anew
MEMO = 700_000
#: pieces that are joined to one text for the library
JOINED = 2_000

# Marks that are a word of their own between a letter (ASCII, or
# of two bytes C3 xx but the signs C3 97 and C3 B7) and a space.
MARKS = ",.;:!?"
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = np.full(256, -1, dtype=np.int64)
_MARK[list(MARKS.encode())] = np.arange(len(MARKS))


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *parts]).astype(np.int32)))


class LibraryIds:
    """Ids as ``library.encode(text, add_special_tokens=False).ids`` gives them."""

    def __init__(self, path: str, memo: int = MEMO):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True  # the space in the byte alphabet
        self.marks = _lists([np.array(e.ids, dtype=np.int32) for e in self._encode(list(MARKS))])
        self.limit = memo
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}  # stem -> row of ids
        self.ids = pa.array([], pa.list_(pa.int32()))

    def _encode(self, texts: list[str]) -> list:
        return self.library.encode_batch_fast(texts, add_special_tokens=False)

    def _encode_pieces(self, pieces: list[str]) -> pa.ListArray:
        """Ids of distinct pieces, each with the space before it."""
        out = []
        for i in range(0, len(pieces), JOINED):
            some = pieces[i : i + JOINED]
            ids = np.array(self._encode([" " + " ".join(some)])[0].ids, dtype=np.int32)
            first = np.flatnonzero(self.opens[ids])
            if len(first) != len(some) or first[0] != 0:
                raise ValueError("the vocabulary has words that are not cut at spaces")
            out.append(pa.ListArray.from_arrays(pa.array(np.append(first, len(ids)).astype(np.int32)), pa.array(ids)))
        return pa.concat_arrays(out)

    def _of_stems(self, stems: pa.Array) -> pa.ListArray:
        """Ids of distinct stems; the memo takes up those it does not hold."""
        words = stems.to_numpy(zero_copy_only=False).tolist()  # much faster than to_pylist()
        at = list(map(self.known.get, words))
        if None in at:
            new = list(dict.fromkeys(w for w, k in zip(words, at, strict=True) if k is None))
            if len(self.known) + len(new) > self.limit:
                self._forget()
                new = list(dict.fromkeys(words))
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.ids = pa.concat_arrays([self.ids, self._encode_pieces(new)])
            at = list(map(self.known.__getitem__, words))
        return self.ids.take(pa.array(at, pa.int64()))

    def _of_pieces(self, pieces: pa.Array) -> pa.ListArray:
        """Ids of distinct pieces, each with the space before it; a mark after
        a letter is a word of its own, so it is looked up apart."""
        data, ends = byte_column(pieces)
        begin, end = ends[:-1], ends[1:]
        long = end - begin >= 2
        mark = np.full(len(pieces), -1)
        before = data[end[long] - 2]
        latin = (data[np.maximum(end[long] - 3, 0)] == 0xC3) & (end[long] - begin[long] >= 3) & (before >= 0x80) & (before < 0xC0) & (before != 0x97) & (before != 0xB7)
        mark[long] = np.where(_LETTER[before] | latin, _MARK[data[end[long] - 1]], -1)
        marked = mark >= 0
        coded = pc.binary_replace_slice(pieces.cast(pa.binary()).filter(pa.array(marked)), start=-1, stop=2**31 - 1, replacement=b"").cast(pa.string())
        stems = pa.concat_arrays([pieces.filter(pa.array(~marked)), coded])
        found = pa.concat_arrays([self._of_stems(stems), self.marks])
        # the words of each piece in order: its stem, then perhaps its mark
        place = np.empty(len(pieces), dtype=np.int64)
        place[~marked] = np.arange((~marked).sum())
        place[marked] = (~marked).sum() + np.arange(marked.sum())
        words = np.empty(len(pieces) + int(marked.sum()), dtype=np.int64)
        at = np.arange(len(pieces)) + np.cumsum(marked) - marked
        words[at] = place
        words[at[marked] + 1] = len(stems) + mark[marked]
        spread = found.take(pa.array(words))
        ends = spread.offsets.to_numpy()[np.append(at, len(words))]
        return pa.ListArray.from_arrays(pa.array(ends), spread.values)

    def many(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of whole texts (null: none), in order."""
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        for i, j in slices(np.append(0, np.cumsum(size, dtype=np.int64)), SLICE):
            yield from self._slice(texts.slice(i, j - i).fill_null("").cast(pa.string()))

    def _slice(self, texts: pa.Array) -> Iterator[np.ndarray]:
        slow = pc.match_substring_regex(texts, f" [{_BLANKS}]| $")
        for s in self.special:
            slow = pc.or_(slow, pc.match_substring(texts, s))
        fast = pc.split_pattern(texts.filter(pc.invert(slow)), " ")
        cuts = fast.offsets.to_numpy() - fast.offsets[0].as_py()
        flat = fast.flatten()
        first = np.zeros(len(flat), dtype=bool)
        first[cuts[:-1]] = True  # no space before it
        coded = flat.dictionary_encode()
        key = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        heads = flat.filter(pa.array(first)).to_pylist()
        key[first] = len(coded.dictionary) + np.arange(len(heads))
        lists = pa.concat_arrays([self._of_pieces(coded.dictionary), _lists([np.array(e.ids, dtype=np.int32) for e in self._encode(heads)])]) if len(heads) else pa.array([], pa.list_(pa.int32()))
        found = lists.take(pa.array(key))
        ids = found.values.to_numpy()
        ends = found.offsets.to_numpy()[cuts] if len(flat) else np.zeros(1, dtype=np.int32)
        whole = iter(self._encode(texts.filter(slow).to_pylist()))
        k = 0
        for is_slow in slow.to_pylist():
            if is_slow:
                yield np.array(next(whole).ids, dtype=np.int32)
            else:
                yield ids[ends[k] : ends[k + 1]]
                k += 1


_ENCODERS: dict[str, LibraryIds] = {}


def encoder(path: str) -> LibraryIds:
    if path not in _ENCODERS:
        _ENCODERS[path] = LibraryIds(path)
    return _ENCODERS[path]
