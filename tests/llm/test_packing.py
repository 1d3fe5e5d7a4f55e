import random
import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from tabsleuth.llm import packing
from tabsleuth.llm._library_ids import LibraryIds
from tabsleuth.llm.queries import tokenizer_path
from tabsleuth.session import scratch_path

from helpers import ODD_TEXTS, documents, prose

BYTES = tokenizer_path("byte_bpe_50k.json")


def test_pieces_are_the_binary_digits():
    for n in [*range(70), 1023, 1024, 1025, 4096 + 7]:
        lengths = packing.piece_lengths(n, 16)
        assert sum(lengths) == n
        assert lengths == sorted(lengths, reverse=True)
        short = [x for x in lengths if x < 16]
        assert len(short) == len(set(short)) and all(x & (x - 1) == 0 for x in lengths)


def test_every_id_lies_in_one_sequence(spark):
    texts = [*ODD_TEXTS, *(prose(i, 10 + 7 * i) for i in range(40)), prose(0, 10), "word " * 6000]
    docs = documents(spark, texts).repartition(5)
    path = scratch_path(spark, "test-packed")
    packing.pack_documents(docs.selectExpr("doc_id", "text", "lang AS length", "source AS part", "row AS ids"), path, BYTES)
    key = docs.schema["doc_id"].dataType
    rows = packing.read_pieces(spark, path, key).collect()
    digests = {(r["doc_id"], r["start"]): r for r in packing.piece_digests(spark, path, key).collect()}
    library = Tokenizer.from_file(BYTES)
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))  # one piece a sequence
    by_length = sorted(rows, key=lambda r: r["sequence_id"])
    assert [r["length"] for r in by_length] == sorted((r["length"] for r in rows), reverse=True)  # buckets
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert [r["length"] for r in own] == packing.piece_lengths(len(ids))
        assert b"".join(bytes(r["ids"]) for r in own) == ids.tobytes()
        assert {r["doc_tokens"] for r in own} == {len(ids)} and {r["offset"] for r in own} == {0}
        for r in own:
            d = digests[(i, r["start"])]
            assert d["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
            assert d["sequence_id"] == r["sequence_id"]
    assert len(digests) == len(rows)


def test_repeated_and_null_rows_and_an_empty_table(spark):
    docs = spark.createDataFrame([(None, "x"), (1, "same"), (1, "same"), (2, None)], "doc_id long, text string")
    key = docs.schema["doc_id"].dataType
    path = scratch_path(spark, "test-packed")
    packing.pack_documents(docs, path, BYTES)
    rows = packing.piece_digests(spark, path, key).collect()
    assert sum(r["length"] for r in rows) == sum(len(Tokenizer.from_file(BYTES).encode(t).ids) + 1 for t in ("x", "same", "same", ""))
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    path = scratch_path(spark, "test-packed")
    packing.pack_documents(docs.limit(0), path, BYTES)
    assert packing.piece_digests(spark, path, key).count() == 0


def test_pieces_and_joined_words_are_cut_as_the_library_cuts_them():
    library = Tokenizer.from_file(BYTES)
    rnd = random.Random(1)
    alphabet = "ab ,.'s \n1é 日🙂!?:;\x1cć×"
    texts = [*ODD_TEXTS, *("".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 40))) for _ in range(4000))]
    small = LibraryIds(BYTES, memo=500)  # the memo starts anew again and again
    for _ in range(2):
        for t, ids in zip(texts, small.many(pa.array(texts)), strict=True):
            assert list(ids) == library.encode(t or "", add_special_tokens=False).ids


def test_code_points_are_cut_as_the_library_cuts_them():
    """Every code point of planes 0, 1 and 14's tags between letters, digits,
    marks and spaces (surrogates are no text)."""
    library = Tokenizer.from_file(BYTES)
    points = [c for c in [*range(0x20000), *range(0xE0000, 0xE0080)] if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{c} {c}, {c}1. x{c}, {c}{c}." for c in map(chr, points[i : i + 64])) for i in range(0, len(points), 64)]
    ids = LibraryIds(BYTES)
    for got, e in zip(ids.many(pa.array(texts)), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got.tolist() == e.ids
