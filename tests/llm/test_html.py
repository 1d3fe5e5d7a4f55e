import html
import re

import numpy as np

from tabsleuth.llm import html_blocks as hb

SF = "/root/testdata/sf0.1"


def test_leaf_blocks():
    page = "<!doctype html><title>t</title><script>if(a<b)'</p>'</script><body>a < b &amp; c<p><b>one<br>two<p>three</b> <i>x</i>&nbsp;y<ul><li><a href=1>l1</a><li>l2</ul><!-- <p>no</p> --><style>p{}</style><textarea>no</textarea><DIV CLASS='Ad big'>ad</div>tail &lt;p&gt; <"
    got = hb.blocks(page)
    assert [b.text for b in got] == ["a < b & c", "one two", "three x y", "l1", "l2", "ad", "tail <p> <"]
    assert [b.linked for b in got] == [0, 0, 0, 1, 0, 0, 0] and got[5].tag == "div"
    assert hb.blocks("") == [] and hb.blocks("<p") == [] and hb.blocks("<!-- x") == []
    assert [b.text for b in hb.blocks("</p></div>a</nope>b")] == ["ab"]


def test_gradients():
    rng = np.random.default_rng(0)
    weights = hb.new_weights(rng)
    x, there = hb._padded([rng.standard_normal((5, hb.INPUT)), rng.standard_normal((3, hb.INPUT))])
    aim = rng.standard_normal((5, 2, hb.HIDDEN))
    keep: list = []
    hb._scan(x, there, weights["wf"], weights["cf"], keep)
    dw, dc = hb._back(aim, keep, weights["wf"])
    for at in [(0, 0), (hb.INPUT + 2, 20), (hb.INPUT - 1, 40), (3, 60)]:
        value = []
        for step in (1e-5, -1e-5):
            w = weights["wf"].copy()
            w[at] += step
            value.append((hb._scan(x, there, w, weights["cf"]) * aim).sum())
        assert abs((value[0] - value[1]) / 2e-5 - dw[at]) < 1e-6 * max(1, abs(dw[at]))
    assert np.isfinite(dc).all()


def test_article_text_and_held_out_variants(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = pages.select("page_id", "html").collect()
    got = {r["page_id"]: r for r in hb.main_text(pages).collect()}
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", r["html"], re.DOTALL)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        assert got[r["page_id"]]["text"] == "\n".join(p for p in parts if p)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])
    weights = hb.train(hb.examples([r["html"] for r in rows[:300]]))
    held = hb.examples([r["html"] for r in rows[300:500]], seed=99)
    right = sum(((p >= 0.5) == y).sum() for (_, y), p in zip(held, hb.probabilities(weights, [x for x, _ in held]), strict=True))
    assert right >= 0.99 * sum(len(y) for _, y in held)


def test_odd_pages(spark):
    page = "<html><body><nav><a href='/'>home</a></nav><article><h1>Head</h1><p>Some text here.</p></article><footer>foot</footer></body></html>"
    rows = [(i, "u", page, "t") for i in range(30)] + [(30, None, None, "t"), (31, "u", "", "t"), (31, "u", "", "t"), (None, "u", page, "t"), (32, "u", "<div>" * 3000 + "deep", "t"), (33, "u", "<article><p>" + "w " * 60000, "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [tuple(r) for r in hb.main_text(df).collect()]
    assert len(got) == len(rows)
    assert all(r[2] == "Head\nSome text here." for r in got if r[0] is None or r[0] < 30)
    assert [r[2] for r in got if r[0] in (30, 31)] == ["", "", ""]
    assert hb.main_text(df.limit(0)).collect() == []
    assert {r["text"] for r in hb.main_text(df.where("page_id = 31")).collect()} == {""}


ARTICLE = ["The harbour was quiet when the first boats came in that morning.", "Nobody had expected so many of them, and there was room for few.", "Energy is E=mc here, as the old sign on the wall still says today."]


def _plain_page(k):
    menu = "".join(f"<li><a href=/{i}>Topic {i}</a></li>" for i in range(5))
    body = "".join(f"<p>{t} Number {k} of the day.</p>" for t in ARTICLE)
    return f"<html><body><ul class=menu>{menu}</ul><div id=content>{body}</div><div class=footer>All rights reserved {k}</div></body></html>"


def test_pages_that_mark_no_article_still_give_it(spark):
    pages = spark.createDataFrame([(k, "u", _plain_page(k)) for k in range(20)], "page_id long, url string, html string")
    for r in hb.main_text(pages).collect():
        assert r["text"].split("\n") == [f"{t} Number {r['page_id']} of the day." for t in ARTICLE]


def test_few_marked_pages_among_many_are_found(spark):
    marked = "<html><body><nav><a href=/>Home</a></nav><article>{}</article><footer>Imprint</footer></body></html>"
    rows = [(k, "u", _plain_page(k)) for k in range(600)] + [(1000 + k, "u", marked.format("".join(f"<p>{t} Case {k}.</p>" for t in ARTICLE))) for k in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    weights = hb.fit(pages)
    assert weights is not None
    got = {r["page_id"]: r["text"] for r in hb.main_text(pages.where("page_id >= 1000")).collect()}
    assert all(got[1000 + k] == "\n".join(f"{t} Case {k}." for t in ARTICLE) for k in range(8))


def test_text_in_math_object_and_noscript_stays():
    page = "<article><p>Energy is <math>E=mc</math> here, <object>a figure</object> and <noscript>no script</noscript>.</p><svg><text>x</text></svg><script>y</script></article>"
    assert [b.text for b in hb.blocks(page)] == ["Energy is E=mc here, a figure and no script."]


def test_unmatched_end_tags_cost_no_more_than_their_number():
    import time

    def seconds(n):
        t0 = time.process_time()
        hb.blocks("<div>" + "<i>" * n + "</b></u></section>" * n + "text")
        return time.process_time() - t0

    seconds(500)
    assert seconds(8000) < 12 * seconds(2000) + 0.2  # 16 times if quadratic
