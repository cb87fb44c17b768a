import re
import time
from html import unescape

import pytest

from credsift.llm import html_extract as hx
from credsift.llm import queries


@pytest.fixture(scope="module")
def trees():
    return hx.train()


def texts(html):
    return [hx.block_text(n) for n in hx.measured(hx.parse(html)) if n.parts is not None]


def test_blocks():
    assert texts("<p>a  b\n c<p>d<br>e</p>f<div>g<b>h</b>i</div>") == ["a b c", "d e", "f", "ghi"]
    assert texts("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>") == ["a", "b", "c", "d", "e"]
    assert texts("<p>x &amp; y&nbsp;&#233;&lt;</p><script>var a='<p>no</p>';</script><style>p{}</style><!-- <p>no</p> -->z") == ["x & y é<", "z"]
    assert texts("<p><b>one<br><p>two</b></p>") == ["one", "two"]
    assert texts("</div></p>a<p title='x>y'>b</p><textarea><p>no</p></textarea>") == ["a", "b"]
    assert texts("<head><title>no</title><body>yes") == ["yes"]
    assert texts("<p>never closed <i>and <b>open") == ["never closed and open"]
    assert texts("<script>never closed <p>x</p>") == []
    assert texts("a < b and 3<4") == ["a < b and 3<4"]


def test_made_pages(trees):
    writer, wrong, blocks = hx.Writer(977), 0, 0
    for _ in range(150):
        order = hx.measured(hx.parse(writer.page()))
        kept = hx.decode(order, trees.log_odds(hx.features(order)))
        for n in order:
            assert n.parent is None or not kept[n.order] or kept[n.parent.order]
            if n.parts is not None:
                blocks += 1
                wrong += kept[n.order] != any(hx.MARK in p for p, _ in n.parts)
    assert wrong < 0.02 * blocks


def test_decoding_is_the_likeliest_consistent_labelling():
    import itertools
    import random

    random.seed(4)
    for _ in range(40):
        root = hx.Node("html", None)
        order = [root]
        for _ in range(7):
            parent = random.choice(order)
            node = hx.Node("div", parent)
            parent.children.append(node)
            order.append(node)
        order = hx.measured(root)
        odds = hx.np.array([random.uniform(-2, 2) for _ in order])
        best = max(
            (sum(o for o, k in zip(odds, (True, *labels), strict=True) if k), (True, *labels))
            for labels in itertools.product((False, True), repeat=len(order) - 1)
            if all((True, *labels)[n.parent.order] or not (True, *labels)[n.order] for n in order if n.parent)
        )
        assert hx.decode(order, odds) == list(best[1])


def plain(html):
    m = re.search(r"<article>(.*)</article>", html or "", re.S)
    parts = re.split(r"</?(?:p|h1)>", m[1]) if m else []
    return "\n".join(t for p in parts if (t := " ".join(unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split())))


def test_the_table(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.op4_html_extraction(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == plain(pages[r.page_id].html)
        assert r.n_chars == len(r.text)
        assert r.url == pages[r.page_id].url


def test_boilerplate_of_other_layouts(trees):
    say = "This is a sentence of the story, told at some length, so that it reads like prose. " * 3
    page = f"""<html><body><div id="cookie-notice"><p>We use cookies to make this site better.</p><button>OK</button></div><header class="site-header"><a href="/">Site</a></header>
    <div class="navbar"><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></div><div class="post-content"><h1>Title of the story</h1><p>{say}</p><div class="advert">Buy this now, it is cheap.</div><p>{say}</p>
    <form><label>Mail</label><input></form></div><div class="comments"><h3>Comments</h3><div class="comment"><p>I liked this a lot, thanks.</p></div></div><div class="sidebar"><h3>Related</h3><a href="/c">C</a></div>
    <div class="footer">&copy; Site. All rights reserved.</div></body></html>"""
    line = " ".join(say.split())
    assert hx.extract([page], trees) == [f"Title of the story\n{line}\n{line}"]


def test_odd_rows(spark, trees):
    rows = [(1, None, "a"), (2, "", "b"), (2, "", "b"), (3, "just text", None), (4, "<p>" * 20_000 + "deep" + "<div>" * 3000, "d")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    out = df.select("*", hx.main_text(spark, trees, df["html"]).alias("main"))
    got = {r.page_id: r.main for r in out.collect()}
    assert got[1] == got[2] == ""
    assert out.count() == 5
    assert df.limit(0).select(hx.main_text(spark, trees, df["html"])).count() == 0


@pytest.mark.parametrize("tag", ["math", "svg", "object", "canvas", "video"])
def test_fallback_text_in_an_article_stays(tag):
    page = f"<html><body><nav><a href=x>Home</a> <a href=y>More</a></nav><article><h1>A title of it</h1><p>Area is <{tag}>x=2</{tag}> metres, as the survey of the whole field had shown before.</p><p>More of it stands here. And so on, and on.</p></article></body></html>"
    assert "Area is x=2 metres, as" in hx.extract([page], hx.train())[0]


@pytest.mark.parametrize(
    "page",
    [
        "<a href=\"x\" " * 90_000,
        "<b>" * 150_000 + "</i>" * 150_000,
        "<b>" * 100_000 + "<hr>" * 100_000,
        "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000,
        "<a \"'> " * 100_000,
        "<a x=' \" >" * 99_999,
        ">" + "<a '" * 100_001 + "\"",
        "<" * 500_000,
        "<!--" * 200_000,
    ],
    ids=["unclosed", "stray", "rules", "hidden", "quotes", "odd quotes", "no end", "signs", "comments"],
)
def test_malformed_pages_take_linear_time(page):
    took = []
    for part in (page[: len(page) // 4], page):
        began = time.process_time()
        hx.measured(hx.parse(part))
        took.append(time.process_time() - began)
    assert took[1] < 12 * max(took[0], 0.02)


def test_raw_text_ends_at_its_own_tag():
    page = "<p>İ one</p><script>if (a<b && \"</p>\") x = '</q>'</SCRIPT><p>two</p>"
    assert [hx.block_text(n) for n in hx.measured(hx.parse(page)) if n.parts] == ["İ one", "two"]
