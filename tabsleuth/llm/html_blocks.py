"""Main text of web pages by a recurrent block labeller.

A page is cut into its leaf blocks (the texts between block-level tags) in page
order. Each block is described by its hashed tag path (names, classes and ids
of everything that is open around it), a hashed vector of its words and a few
numbers. A bidirectional LSTM in numpy reads the whole sequence and classifies
every block, so a decision can depend on all of the page.

The model is trained here, on at most ``SAMPLE`` pages taken by the order of a
hash of their id among those that mark their article themselves (``article`` or
``main`` outside of navigation, adverts, comments and the like), which gives the
labels. If no page of the table does, the sample is of all pages, and blocks of
sentences outside links stand for the article. So that it doesn't rest on that markup alone, every sampled page also
gives variants with its blocks under other containers, side bars, notices,
forms and reader comments. The weights are a few thousand numbers, broadcast.

Defined cases: null or empty html gives the empty text; a page without a block
of the article gives the empty text; a page cut off anywhere is read as far as
it goes; stray ``<`` is text; repeated rows and equal ids each keep their
result; without sample pages nothing is kept; other columns are not read.
Memory of a task: the weights, one batch of pages, and the longest page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import byte_column, tidy, token_hashes

SAMPLE = 400
VARIANTS = 3
EPOCHS = 6
LEAST_STEPS = 150
HIDDEN = 16
PATH_SIZE, WORD_SIZE, NUMBERS = 64, 32, 7
INPUT = PATH_SIZE + WORD_SIZE + NUMBERS
#: blocks of a training sequence, pages labelled together
STRETCH, TOGETHER = 64, 256

# Element names of HTML by the way they break text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title template iframe svg".split())
_CLOSED_BY_SAME = frozenset("li dd dt td th tr option p".split())
_NOT_ARTICLE = re.compile(r"^(nav|aside|footer|header|form|menu|dialog|button|select|fieldset)$|(^|[.#\-_])(ads?|advert\w*|banner|promo|sponsor\w*|comments?|replies|disqus|sidebar|menu|nav|footer|header|cookies?|consent|notice|share|social|related|subscribe|newsletter|login)($|[\-_])")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.DOTALL)
_DIGIT = re.compile(r"\d")
_ATTRIBUTE = re.compile(r"\b(class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)


def _bucket(name: str, size: int) -> int:
    h = 2166136261
    for b in name.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return (h ^ (h >> 15)) % size


_BUCKETS: dict[str, int] = {}


def _path_bucket(name: str) -> int:
    if (b := _BUCKETS.get(name)) is None:
        b = _bucket(name, PATH_SIZE)
        if len(_BUCKETS) < 100_000:
            _BUCKETS[name] = b
    return b


def _names(tag: str, attributes: str) -> list[str]:
    out = [tag]
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            mark = "." if m[1].lower() == "class" else "#"
            out += [mark + v.lower() for v in (m[2] or m[3] or m[4] or "").split()]
    return out


class Block:
    """A leaf block: text, share of it inside links, open names, path vector."""

    __slots__ = ("linked", "path", "tag", "text", "marked")

    def __init__(self, text: str, linked: float, tag: str, path: np.ndarray, marked: bool):
        self.text, self.linked, self.tag, self.path, self.marked = text, linked, tag, path, marked


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page, in order."""
    out: list[Block] = []
    stack: list[str] = []
    where: dict[str, list[int]] = {}  # places of an open tag in the stack
    block_at: list[int] = []  # places of the open block tags
    paths = [np.zeros(PATH_SIZE, dtype=np.float32)]
    marks = [(False, False)]  # inside an article, inside something that is none
    pieces: list[str] = []
    linked = depth_a = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                inside, outside = marks[-1]
                own = stack[block_at[-1]] if block_at else ""
                out.append(Block(text, min(1.0, linked / len(text)), own, paths[-1], inside and not outside))
            pieces.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        text = html.unescape(text) if "&" in text else text
        pieces.append(text)
        if depth_a:
            linked += len(text)

    def pop() -> None:
        nonlocal depth_a
        tag = stack.pop()
        where[tag].pop()
        if tag in BLOCK_TAGS:
            block_at.pop()
        depth_a -= tag == "a"
        paths.pop()
        marks.pop()

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if where.get(tag):
                if tag in BLOCK_TAGS:
                    flush()
                    while stack[-1] != tag:
                        pop()
                    pop()
                else:  # an inline end tag closes nothing beyond its block
                    k = where[tag][-1]
                    if k > (block_at[-1] if block_at else -1):
                        while len(stack) > k:
                            pop()
            elif tag in BLOCK_TAGS:
                flush()
            continue
        if tag in RAW_TAGS:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
            if not m[0].endswith("/>"):
                at = end.end() if end else n
            continue
        if tag in BLOCK_TAGS:
            flush()
            while stack and (stack[-1] not in BLOCK_TAGS or stack[-1] == "p" or (stack[-1] == tag and tag in _CLOSED_BY_SAME)):
                closed = stack[-1]
                pop()
                if closed == tag:
                    break
        elif tag == "br":
            pieces.append(" ")
        if tag in VOID_TAGS or m[0].endswith("/>"):
            continue
        names = _names(tag, m[3])
        path = paths[-1].copy()
        for name in names:
            path[_path_bucket(name)] = 1.0
        where.setdefault(tag, []).append(len(stack))
        if tag in BLOCK_TAGS:
            block_at.append(len(stack))
        stack.append(tag)
        paths.append(path)
        inside, outside = marks[-1]
        marks.append((inside or tag in ("article", "main"), outside or any(_NOT_ARTICLE.search(x) for x in names)))
        depth_a += tag == "a"
    flush()
    return out


def describe(sequence: list[Block]) -> np.ndarray:
    """(blocks, INPUT) features."""
    n = len(sequence)
    out = np.zeros((n, INPUT), dtype=np.float64)
    if not n:
        return out
    out[:, :PATH_SIZE] = np.stack([b.path for b in sequence])
    buf, offsets = byte_column(pa.array([b.text for b in sequence], pa.string()))
    tokens, row = token_hashes(buf, offsets)
    words = np.bincount(row, minlength=n)
    bag = np.bincount(row * WORD_SIZE + (tokens % np.uint64(WORD_SIZE)).astype(np.int64), minlength=n * WORD_SIZE).reshape(n, WORD_SIZE)
    out[:, PATH_SIZE : PATH_SIZE + WORD_SIZE] = bag / np.maximum(1, words)[:, None]
    chars = np.array([len(b.text) for b in sequence])
    digits = np.array([len(_DIGIT.findall(b.text)) for b in sequence])
    out[:, -7] = np.log1p(chars) / 8
    out[:, -6] = np.log1p(words) / 6
    out[:, -5] = [b.linked for b in sequence]
    out[:, -4] = digits / chars
    out[:, -3] = [b.text[-1] in ".!?…:;\"'”»" for b in sequence]
    out[:, -2] = np.arange(n) / max(1, n - 1)
    out[:, -1] = [b.tag in ("h1", "h2", "h3", "h4", "h5", "h6") for b in sequence]
    return out


# ------------------------------------------------------------------ the model


def new_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    out = {}
    for side in "fb":
        out[f"w{side}"] = rng.standard_normal((INPUT + HIDDEN, 4 * HIDDEN)) / np.sqrt(INPUT + HIDDEN)
        out[f"c{side}"] = np.concatenate((np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)))  # forget gates start open
    out["wo"], out["co"] = rng.standard_normal(2 * HIDDEN) / np.sqrt(2 * HIDDEN), np.zeros(1)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def _scan(x: np.ndarray, there: np.ndarray, w: np.ndarray, c: np.ndarray, keep: list | None = None) -> np.ndarray:
    """One direction over (steps, pages, INPUT); ``there`` marks real blocks."""
    steps, pages, _ = x.shape
    h, s = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
    out = np.zeros((steps, pages, HIDDEN))
    for t in range(steps):
        both = np.concatenate((x[t], h), axis=1)
        gate = both @ w + c
        i, f, o = (_sigmoid(gate[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(gate[:, 3 * HIDDEN :])
        on = there[t][:, None]
        new = f * s + i * g
        squashed = np.tanh(new)
        if keep is not None:
            keep.append((both, i, f, o, g, s, squashed, on))
        s = np.where(on, new, s)
        h = np.where(on, o * squashed, h)
        out[t] = h
    return out


def _back(grad: np.ndarray, keep: list, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of a direction's weights."""
    dw, dc = np.zeros_like(w), np.zeros(w.shape[1])
    dh = ds = np.zeros(grad.shape[1:])
    for t in range(len(keep) - 1, -1, -1):
        both, i, f, o, g, s, squashed, on = keep[t]
        dh = dh + grad[t]
        inner = np.where(on, dh, 0)
        dnew = np.where(on, ds, 0) + inner * o * (1 - squashed**2)
        gate = np.concatenate((dnew * g * i * (1 - i), dnew * s * f * (1 - f), inner * squashed * o * (1 - o), dnew * i * (1 - g**2)), axis=1)
        dw += both.T @ gate
        dc += gate.sum(axis=0)
        ds = np.where(on, dnew * f, ds)
        dh = np.where(on, 0, dh) + (gate @ w.T)[:, INPUT:]
    return dw, dc


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(r) for r in rows)
    x, there = np.zeros((steps, len(rows), INPUT)), np.zeros((steps, len(rows)), dtype=bool)
    for k, r in enumerate(rows):
        x[: len(r), k] = r
        there[: len(r), k] = True
    return x, there


def probabilities(weights: dict[str, np.ndarray], rows: list[np.ndarray]) -> list[np.ndarray]:
    """Per page the probability of each block to belong to the article."""
    out = [np.zeros(0)] * len(rows)
    order = sorted((k for k in range(len(rows)) if len(rows[k])), key=lambda k: len(rows[k]))
    first = 0
    while first < len(order):  # pages of like length together, long ones fewer at a time
        last = first + 1
        while last < len(order) and last - first < TOGETHER and len(rows[order[last]]) <= 2 * len(rows[order[first]]) + 8 and (last - first + 1) * len(rows[order[last]]) <= 1 << 14:
            last += 1
        own = order[first:last]
        x, there = _padded([rows[k] for k in own])
        ahead = _scan(x, there, weights["wf"], weights["cf"])
        behind = _scan(x[::-1], there[::-1], weights["wb"], weights["cb"])[::-1]
        p = _sigmoid(np.concatenate((ahead, behind), axis=2) @ weights["wo"] + weights["co"])
        for j, k in enumerate(own):
            out[k] = p[: len(rows[k]), j]
        first = last
    return out


def train(examples: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights by Adam on sequences of (features, labels)."""
    rng = np.random.default_rng(seed)
    weights = new_weights(rng)
    cut = [(x[a : a + STRETCH], y[a : a + STRETCH]) for x, y in examples for a in range(0, len(x), STRETCH)]
    first, second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    epochs = max(epochs, -(-LEAST_STEPS // max(1, -(-len(cut) // 32))))  # small samples are read more often
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(cut))
        for a in range(0, len(order), 32):
            some = [cut[k] for k in order[a : a + 32]]
            x, there = _padded([s[0] for s in some])
            y = np.zeros(there.shape)
            for k, s in enumerate(some):
                y[: len(s[1]), k] = s[1]
            keep_f: list = []
            keep_b: list = []
            ahead = _scan(x, there, weights["wf"], weights["cf"], keep_f)
            behind = _scan(x[::-1], there[::-1], weights["wb"], weights["cb"], keep_b)[::-1]
            both = np.concatenate((ahead, behind), axis=2)
            error = np.where(there, _sigmoid(both @ weights["wo"] + weights["co"]) - y, 0) / there.sum()
            grad = {"wo": np.einsum("tp,tph->h", error, both), "co": np.array([error.sum()])}
            dh = error[:, :, None] * weights["wo"]
            grad["wf"], grad["cf"] = _back(dh[:, :, :HIDDEN], keep_f, weights["wf"])
            grad["wb"], grad["cb"] = _back(dh[::-1, :, HIDDEN:], keep_b, weights["wb"])
            step += 1
            rate = 0.01 * (1 if epoch < epochs - 2 else 0.3)
            for k, g in grad.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return weights


# ------------------------------------------------------------- training pages

_ARTICLES = ("<article>{}</article>", "<main>{}</main>", '<div id="content">{}</div>', '<div class="post"><div class="entry-content">{}</div></div>', '<section class="article-body">{}</section>', '<main><article class="story">{}</article></main>', "<table><tr><td>{}</td></tr></table>")
_OTHERS = (
    "<nav><ul><li><a href='/'>{}</a></li><li><a href='/x'>{}</a></li><li><a href='/y'>{}</a></li></ul></nav>",
    '<div class="menu"><a href="/">{}</a> <a href="/a">{}</a></div>', "<header><p>{}</p><p>{}</p></header>", "<footer><p>{}</p></footer>", '<div id="footer">{}</div>', '<div class="ad">{}</div>',
    '<div class="advert banner"><p>{}</p></div>', '<aside class="sidebar"><h3>{}</h3><ul><li><a href="/b">{}</a></li></ul></aside>', '<div id="sidebar"><p>{}</p></div>', '<div class="cookie-notice">{}<button>{}</button></div>',
    '<form action="/s"><label>{}</label><input><button>{}</button></form>', '<div class="related"><a href="/c">{}</a></div>', '<div class="newsletter"><p>{}</p></div>',
)
_COMMENTS = ('<section id="comments"><h3>{}</h3><div class="comment"><p>{}</p></div><div class="comment"><p>{}</p></div></section>', '<div class="comments"><ul><li class="comment">{}</li><li class="comment">{}</li></ul></div>', '<ol class="replies"><li>{}</li></ol>')


def variant(rng: np.random.Generator, article: list[str], others: list[str], foreign: list[str]) -> tuple[str, list[bool]]:
    """A page made of given texts under other markup, and its blocks' labels.
    ``foreign`` are paragraphs of another page, for comments and notices."""
    html_of, labels = [], []

    def put(pattern: str, texts: list[str]) -> None:
        n = pattern.count("{}")
        own = [html.escape(texts[rng.integers(len(texts))]) for _ in range(n)]
        html_of.append(pattern.format(*own))
        labels.extend([False] * n)

    short = others or foreign
    for _ in range(rng.integers(0, 4)):
        put(_OTHERS[rng.integers(len(_OTHERS))], short if rng.random() < 0.7 else foreign)
    inner = []
    for k, text in enumerate(article):
        inner.append(f"<h1>{html.escape(text)}</h1>" if k == 0 and rng.random() < 0.7 else f"<p>{html.escape(text)}</p>")
        labels.append(True)
        if rng.random() < 0.05:
            inner.append(f'<div class="ad">{html.escape(short[rng.integers(len(short))])}</div>')
            labels.append(False)
    html_of.append(_ARTICLES[rng.integers(len(_ARTICLES))].format("".join(inner)))
    if rng.random() < 0.5:
        put(_COMMENTS[rng.integers(len(_COMMENTS))], foreign)
    for _ in range(rng.integers(1, 4)):
        put(_OTHERS[rng.integers(len(_OTHERS))], short if rng.random() < 0.7 else foreign)
    return f"<html><body>{''.join(html_of)}</body></html>", labels


def looks_like_prose(block: Block) -> bool:
    """Whether a block of a page that marks nothing may stand for an article's
    text in a variant: sentences outside links."""
    return block.linked < 0.3 and len(block.text.split()) >= 12 and block.text[-1] in ".!?…:;\"'”»"


def examples(pages: list[str], seed: int = 11) -> list[tuple[np.ndarray, np.ndarray]]:
    """Training sequences of pages that mark their article, and of variants. If
    none does, the pages' prose stands for their articles, in the pages and in
    the variants."""
    rng = np.random.default_rng(seed)
    every = list(map(blocks, pages))
    read = [b for b in every if any(x.marked for x in b)]
    if not read:
        for own in every:
            for x in own:
                x.marked = looks_like_prose(x)
        read = [b for b in every if any(x.marked for x in b)]
    out = [(describe(b), np.array([x.marked for x in b], dtype=float)) for b in read]
    for k, own in enumerate(read):
        foreign = [x.text for x in read[(k + 1) % len(read)] if x.marked]
        article, others = [x.text for x in own if x.marked], [x.text for x in own if not x.marked]
        for _ in range(VARIANTS):
            page, labels = variant(rng, article[:STRETCH], others, foreign)
            found = blocks(page)
            if len(found) == len(labels):
                out.append((describe(found), np.array(labels, dtype=float)))
    return out


def fit(df: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> dict[str, np.ndarray] | None:
    """The model from at most ``sample`` pages: of those that mark an article,
    or, where none does, of all; None if no page has text to learn from."""
    key = F.xxhash64(F.col(f"`{id_col}`").cast("string"))
    pages = df.select(key.alias("turn"), F.col(f"`{html_col}`").cast("string").alias("html")).where("html is not null")
    order = ["turn", F.xxhash64("html")]
    chosen = pages.where(F.col("html").rlike(r"(?i)<(article|main)[\s>/]")).orderBy(*order).limit(sample)
    if chosen.isEmpty():
        chosen = pages.orderBy(*order).limit(sample)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages = [p for batch in batches for p in batch.column(0).to_pylist()]
        found = examples(pages)
        if found:
            weights = train(found)
            yield pa.RecordBatch.from_arrays([pa.array(list(weights)), pa.array([v.reshape(-1).tolist() for v in weights.values()], pa.list_(pa.float64())), pa.array([list(v.shape) for v in weights.values()], pa.list_(pa.int32()))], names=["name", "value", "shape"])

    rows = chosen.select("html").coalesce(1).mapInArrow(tidy(learn), "name string, value array<double>, shape array<int>").collect()
    return {r["name"]: np.array(r["value"]).reshape(r["shape"]) for r in rows} or None


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars, n_blocks, n_kept."""
    pages = df.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    sent = df.sparkSession.sparkContext.broadcast(fit(pages))
    schema = T.StructType([*pages.schema.fields[:2], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_blocks", T.LongType()), T.StructField("n_kept", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = sent.value
        for batch in batches:
            for i in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(i, TOGETHER)
                found = [blocks(h or "") for h in part.column(2).to_pylist()]
                p = probabilities(weights, [describe(b) for b in found]) if weights else [np.zeros(len(b)) for b in found]
                kept = [[b.text for b, q in zip(own, ps, strict=True) if q >= 0.5] for own, ps in zip(found, p, strict=True)]
                texts = ["\n".join(k) for k in kept]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()), pa.array(list(map(len, found)), pa.int64()), pa.array(list(map(len, kept)), pa.int64())],
                    names=schema.names,
                )

    return pages.mapInArrow(tidy(run), schema)
