import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabsleuth.llm import chat_format as chat

HOSTILE = ["", "\\", "<turn>", "</turn>\n", "\\### Assistant: </turn> ok", "<|image_1|>", "\\<|image_1|>", "a<|b", "<", "x\\\\</turn>"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="\\<|>/turn\nimage_1é ", max_size=40), st.text(alphabet="\\<>n\nuser", max_size=8))
def test_turns_are_read_back(text, role):
    piece, _, _ = chat.format_turn(role, [{"type": "text", "text": text}, {"type": "image", "ref": "r"}])
    assert chat.read_turn(piece) == (role, text)
    assert chat.unescape(chat.escape(text)) == text


def test_parts_become_ordered_placeholders_and_attachments():
    parts = [{"type": "image", "ref": "i.png", "width": 600, "height": 512}, {"type": "text", "text": "see <|image_1|>"}, None, {"type": "audio", "ref": "a.wav", "seconds": 2.02}, {"type": "document", "ref": None, "pages": 3}]
    piece, loss, found = chat.format_turn("assistant", parts)
    assert piece == "<turn>assistant\n<|image_1|>see \\<|image_1|><|audio_2|><|document_3|></turn>\n"
    assert [piece[a:b] for a, b in loss] == ["see \\<|image_1|>"]
    assert [(a["index"], a["type"], a["ref"], a["n_tokens"]) for a in found] == [(1, "image", "i.png", 512), (2, "audio", "a.wav", 51), (3, "document", None, 2304)]
    assert chat.read_turn(piece) == ("assistant", "see <|image_1|>")
    with pytest.raises(ValueError):
        chat.format_turn("user", [{"type": "video"}])


def test_digests_of_conversations(spark):
    rows = [(c, t, r, x) for c in (1, None) for t, (r, x) in enumerate(zip(["system", "user", "assistant", None, "assistant"], ["s", HOSTILE[4], HOSTILE[4], None, "é\\"]))]
    rows += [(2, 0, "user", h) for h in HOSTILE] + [(2, 0, "user", "")]  # ties and a repeated row
    df = spark.createDataFrame([(*r, "p") for r in rows], "conv_id long, turn long, role string, text string, piece string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    for c in (1, None):
        own = [(r or "", x or "") for k, _, r, x in rows if k == c]
        assert got[c]["n_turns"] == 5
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in own).encode()).hexdigest()
        masked = "".join(x for r, x in own if r == "assistant")
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(masked), hashlib.sha256(masked.encode()).hexdigest())
    assert got[2]["n_turns"] == len(HOSTILE) + 1
    assert chat.read_back(chat.format_conversations(df.limit(0))).collect() == []


def test_part_columns(spark):
    df = spark.sql("SELECT 1L AS conv_id, 0L AS turn, 'user' AS role, 'hi' AS text, array(named_struct('type', 'image', 'text', null, 'ref', 'x', 'width', 10, 'height', 10, 'seconds', null, 'pages', null)) AS parts")
    out = chat.format_conversations(df, parts_col="parts").collect()[0]
    assert out["piece"] == "<turn>user\nhi<|image_1|></turn>\n" and out["attachments"][0]["ref"] == "x" and out["n_attachment_tokens"] == 256
    assert chat.read_back(chat.format_conversations(df, parts_col="parts")).collect()[0]["n_attachments"] == 1


def test_control_strings_across_text_parts_are_escaped():
    from tabsleuth.llm.chat_format import format_turn, read_turn

    parts = [{"type": "text", "text": "a <"}, {"type": "text", "text": "|image_1|> b"}, None, {"type": "text", "text": " </tu"}, {"type": "text", "text": "rn>"}, {"type": "image", "ref": "r", "width": 1, "height": 1}, {"type": "text", "text": "|> \\"}]
    piece, loss, attached = format_turn("assistant", parts)
    assert read_turn(piece) == ("assistant", "a <|image_1|> b </turn>|> \\")
    assert len(attached) == 1 and len(loss) == 2
