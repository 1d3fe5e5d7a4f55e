"""Chat formatting with typed content parts.

A visitor walks the parts of a turn in order. Text is escaped; an image, audio
or document part becomes a numbered placeholder and an attachment record with
its reference and the number of tokens that the placeholder expands to. A
formatted conversation is the concatenation of its turns' pieces::

    <turn>ROLE\\nBODY</turn>\\n

Inside texts a backslash stands before every backslash and before the ``<`` of
every control string (``<turn>``, ``</turn>``, ``<|``), and in a role also
``\\n`` stands for a line break, so that the format can be read back exactly.
The loss mask of a piece is a list of [start, end) code-point spans over the
escaped text of assistant turns; marks and placeholders are never under it.

Pieces stay one row per turn: a conversation may be far larger than a string
can hold. Reading back sorts the turns of a conversation (Spark's external
sort) and folds them one by one, so a task's memory is one batch of rows even
if one conversation holds a third of all rows; only the digest itself, which
SHA-256 defines as sequential, runs in one task per conversation.

Defined cases: null texts and null roles are read as empty; null turns come
first; rows with equal turns are ordered by role, then text, and all are kept;
null conversation ids form one conversation; an empty table gives no rows; a
null part list or null part adds nothing; a part of an unknown type raises
ValueError. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import tidy

OPEN, CLOSE = "<turn>", "</turn>\n"
_CONTROL = re.compile(r"\\|<(?=/?turn>|\|)")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_PLACEHOLDER = re.compile(r"(?<!\\)(?:\\\\)*(<\|(?:image|audio|document)_\d+\|>)")

#: Tokens that a placeholder expands to: per image tile, second, page.
TILE_PIXELS, TILE_TOKENS, SECOND_TOKENS, PAGE_TOKENS = 512, 256, 25, 768

PART = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()),
    T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("seconds", T.DoubleType()), T.StructField("pages", T.IntegerType()),
])
ATTACHMENT = T.StructType([T.StructField("index", T.IntegerType()), T.StructField("type", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("n_tokens", T.LongType())])
SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


@dataclass
class FlattenParts:
    """Visitor over typed parts: collects the body, the text spans within it,
    the attachments and the expanded token count."""

    body: list[str] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    at: int = 0
    pending: list[str] = field(default_factory=list)

    def visit(self, part: dict | None) -> None:
        if part is None:
            return
        method = {"text": self.text, "image": self.image, "audio": self.audio, "document": self.document}.get(part.get("type"))
        if method is None:
            raise ValueError(f"unknown part type {part.get('type')!r}")
        method(part)

    def text(self, part: dict) -> None:
        self.pending.append(part.get("text") or "")

    def end_of_text(self) -> None:
        """Neighbouring text parts are one text, escaped as a whole: what is a
        control string across their border is escaped too."""
        piece = escape("".join(self.pending))
        self.pending = []
        if piece:
            self.spans.append((self.at, self.at + len(piece)))
        self._put(piece)

    def image(self, part: dict) -> None:
        tiles = max(1, math.ceil((part.get("width") or 0) / TILE_PIXELS)) * max(1, math.ceil((part.get("height") or 0) / TILE_PIXELS))
        self._attach("image", part, tiles * TILE_TOKENS)

    def audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil((part.get("seconds") or 0.0) * SECOND_TOKENS))

    def document(self, part: dict) -> None:
        self._attach("document", part, max(1, part.get("pages") or 0) * PAGE_TOKENS)

    def _attach(self, kind: str, part: dict, n_tokens: int) -> None:
        self.end_of_text()
        index = len(self.attachments) + 1
        self.attachments.append({"index": index, "type": kind, "ref": part.get("ref"), "n_tokens": n_tokens})
        self._put(f"<|{kind}_{index}|>")

    def _put(self, piece: str) -> None:
        self.body.append(piece)
        self.at += len(piece)


def format_turn(role: str | None, parts: list[dict | None]) -> tuple[str, list[tuple[int, int]], list[dict]]:
    """The piece of one turn, its loss spans and its attachments."""
    visitor = FlattenParts()
    for part in parts:
        visitor.visit(part)
    visitor.end_of_text()
    head = f"{OPEN}{escape_role(role or '')}\n"
    loss = [(a + len(head), b + len(head)) for a, b in visitor.spans] if role == "assistant" else []
    return head + "".join(visitor.body) + CLOSE, loss, visitor.attachments


def read_turn(piece: str) -> tuple[str, str]:
    """Role and text (placeholders taken out) of a piece."""
    if not (piece.startswith(OPEN) and piece.endswith(CLOSE)):
        raise ValueError("not a formatted turn")
    role, _, body = piece[len(OPEN) : -len(CLOSE)].partition("\n")
    if "<|" in body:
        body = _PLACEHOLDER.sub(lambda m: m[0][: -len(m[1])], body)
    return unescape_role(role), unescape(body)


def format_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None) -> DataFrame:
    """One formatted piece per row: conv_id, turn, role, text_key, piece, loss
    (spans), attachments, n_attachment_tokens. With ``parts_col`` (an array of
    ``PART``) its parts follow the text of the row."""
    col = lambda name: F.col(f"`{name}`")
    rows = df.select(
        col(conv_col).alias("conv_id"), col(turn_col).alias("turn"), col(role_col).cast("string").alias("role"), col(text_col).cast("string").alias("text"),
        (col(parts_col).cast(T.ArrayType(PART)) if parts_col else F.lit(None).cast(T.ArrayType(PART))).alias("parts"),
    )
    schema = T.StructType([
        *rows.schema.fields[:3], T.StructField("piece", T.StringType()), T.StructField("loss", T.ArrayType(SPAN)),
        T.StructField("attachments", T.ArrayType(ATTACHMENT)), T.StructField("n_attachment_tokens", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attachment = pa.struct([("index", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("n_tokens", pa.int64())])
        for batch in batches:
            pieces, losses, found = [], [], []
            for role, text, parts in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                piece, loss, attachments = format_turn(role, [{"type": "text", "text": text}, *(parts or [])])
                pieces.append(piece)
                losses.append([{"start": a, "end": b} for a, b in loss])
                found.append(attachments)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(3)), pa.array(pieces, pa.string()), pa.array(losses, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(found, pa.list_(attachment)), pa.array([sum(a["n_tokens"] for a in x) for x in found], pa.int64()),
                ],
                names=schema.names,
            )

    return rows.mapInArrow(tidy(run), schema)


def read_back(pieces: DataFrame) -> DataFrame:
    """Per conversation, from the formatted pieces alone: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars, n_attachments,
    n_attachment_tokens."""
    rows = pieces.select("conv_id", "turn", "role", "piece", "loss", F.size("attachments").cast("long").alias("n_attachments"), "n_attachment_tokens")
    rows = rows.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc_nulls_first("role"), "piece")
    key = rows.schema["conv_id"]
    counts = ["n_turns", "loss_chars", "formatted_chars", "n_attachments", "n_attachment_tokens"]
    schema = T.StructType([key, T.StructField("turns_sha256", T.StringType()), T.StructField("loss_sha256", T.StringType()), *(T.StructField(c, T.LongType()) for c in counts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, names = None, schema.names

        def row() -> dict:
            return {"conv_id": state["key"], "turns_sha256": state["turns"].hexdigest(), "loss_sha256": state["under"].hexdigest()} | {c: state[c] for c in counts}

        for batch in batches:
            kinds = pa.schema([(n, batch.schema.field(0).type if n == "conv_id" else pa.int64() if n in counts else pa.string()) for n in names])
            out = []
            for conv, piece, loss, n, tokens in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "loss", "n_attachments", "n_attachment_tokens")), strict=True):
                if state is None or state["key"] != conv:
                    if state is not None:
                        out.append(row())
                    state = {"key": conv, "turns": hashlib.sha256(), "under": hashlib.sha256()} | dict.fromkeys(counts, 0)
                role, text = read_turn(piece)
                state["turns"].update(f"{role}\n{text}\n".encode())
                masked = "".join(unescape(piece[s["start"] : s["end"]]) for s in loss)
                state["under"].update(masked.encode())
                for c, v in zip(counts, (1, len(masked), len(piece), n, tokens), strict=True):
                    state[c] += v
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=kinds)
        if state is not None:
            yield pa.RecordBatch.from_pylist([row()], schema=kinds)

    return rows.mapInArrow(tidy(run), schema).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "n_attachment_tokens")
