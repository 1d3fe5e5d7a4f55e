import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import ODD_TEXTS, documents, prose
from tokenizers import Tokenizer

from tabsleuth.llm import bitplane, bpe, token_count
from tabsleuth.session import scratch_path

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def wild_texts():
    rnd = random.Random(5)
    kinds = [lambda: rnd.randrange(32, 127), lambda: rnd.randrange(0x20, 0x300), lambda: rnd.randrange(0x370, 0x2FFF), lambda: rnd.choice([9, 10, 13, 32, 0x1C, 0x85, 0xA0, 0x3A3, 0x27, 0x1F642])]
    return ["".join(chr(rnd.choice(kinds)()) for _ in range(rnd.randrange(60))) for _ in range(1500)] + ["ΑΣ ΣΑΣ", "İx", "don't we'LL  \n x"]


def test_codec_equals_the_library():
    library, own = Tokenizer.from_file(BYTES), bpe.BytePairCodec(BYTES)
    for text in wild_texts() + [t or "" for t in ODD_TEXTS]:
        ids = own.encode(text).tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids, text
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert own.decode([]) == "" and own.decode([10**6, -1]) == ""


def test_counter_equals_the_library():
    library, own = Tokenizer.from_file(WORDS), token_count.counter(WORDS)
    for text in wild_texts() + [t or "" for t in ODD_TEXTS]:
        assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids), text


def test_memo_of_any_size_gives_the_same(monkeypatch):
    texts = [prose(i, 60) for i in range(30)]
    small = bpe.BytePairCodec(BYTES)
    small.pieces.words.limit = small.pieces.spaced.limit = 7
    large = bpe.BytePairCodec(BYTES)
    assert [small.encode(t).tolist() for t in texts] == [large.encode(t).tolist() for t in texts]


def test_round_trip_query(spark):
    texts = ODD_TEXTS + ODD_TEXTS[:4]
    library = Tokenizer.from_file(BYTES)
    got = {r["doc_id"]: r for r in bpe.round_trip_digests(documents(spark, texts), BYTES).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip_digests(documents(spark, []), BYTES).collect() == []
    with pytest.raises(ValueError):
        bpe.encode_documents(documents(spark, ["a"]), BYTES, ids_col="TEXT")


def test_token_counts_query(spark):
    got = {r["doc_id"]: r for r in token_count.token_counts(documents(spark, ODD_TEXTS), WORDS, limit=5).collect()}
    library = Tokenizer.from_file(WORDS)
    for i, t in enumerate(ODD_TEXTS):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 5)
    assert token_count.token_counts(documents(spark, []), WORDS).count() == 0


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_blocks_survive_packing(kind):
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 9, 1000, 65536):
        for high in (1, 2, 50257, 2**32):
            ids = rng.integers(0, high, n, dtype=np.uint64).astype("<u4")
            assert (bitplane.unpack(bitplane.pack(ids, kind)) == ids).all()
    with pytest.raises(ValueError):
        bitplane.unpack(b"what is this")


def test_crc32_of_joined_parts():
    rnd = random.Random(2)
    for _ in range(50):
        a, b = rnd.randbytes(rnd.randrange(40)), rnd.randbytes(rnd.choice([0, 1, 5, 4000]))
        assert bitplane.crc32_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.mark.parametrize("block", [16, 4096])
def test_written_ids_come_back_in_order(spark, block):
    texts = [*ODD_TEXTS, *(prose(i, 30 + i) for i in range(40))]
    docs = documents(spark, texts).selectExpr("50 - doc_id AS doc_id", "text", "lang AS ids", "source AS shard")
    path = scratch_path(spark, "test-ids")
    bitplane.write_ids(docs, path, BYTES, block=block)
    got = {r["doc_id"]: r for r in bitplane.id_digests(spark, path).collect()}
    library, at = Tokenizer.from_file(BYTES), 0
    for i in sorted(got):
        ids = np.array([*library.encode(texts[50 - i] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(got) == len(texts)


def test_equal_and_null_ids_are_kept_and_an_empty_table_is_fine(spark):
    rows = spark.createDataFrame([(None, "x"), (1, "same"), (1, "same"), (1, "other"), (0, None)], "doc_id long, text string")
    path = scratch_path(spark, "test-ids")
    bitplane.write_ids(rows, path, BYTES)
    got = sorted(bitplane.id_digests(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 0, 1, 1, 1]
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    path = scratch_path(spark, "test-ids")
    bitplane.write_ids(rows.limit(0), path, BYTES)
    assert bitplane.id_digests(spark, path).count() == 0


def test_every_code_point_is_counted_as_the_library_counts_it():
    """Planes 0 and 1 and the tags of plane 14, between letters (surrogates are no text)."""
    library, counter = Tokenizer.from_file(WORDS), token_count.counter(WORDS)
    points = [c for c in [*range(0x20000), *range(0xE0000, 0xE0080)] if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}b {chr(c)}" for c in points]
    bad = [hex(c) for c, t, e in zip(points, texts, library.encode_batch(texts, add_special_tokens=False), strict=True) if counter.count(t) != len(e.ids)]
    assert bad == []
