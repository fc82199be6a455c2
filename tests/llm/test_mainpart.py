"""Main text of pages: layouts with and without marks of their own, references, ties, broken and empty pages."""

import re

import pytest

from siftlode.llm import mainpart
from siftlode.llm.mainpart import main_text

PROSE = [f"This is sentence one of paragraph {i}, and it is of some length. A second one follows; it has marks, too." for i in range(6)]
ARTICLE = "<h1>The title</h1>" + "".join(f"<p>{p}</p>" for p in PROSE) + "<p>Short.</p>"
WANT = " ".join(["The title", *PROSE, "Short."])
MENU = '<ul class="x1">' + "".join(f'<li><a href="/{i}">Item {i}</a></li>' for i in range(12)) + "</ul>"
JUNK = '<script>if (a < b) document.write("<p>no, no.</p>")</script><style>p{a:b}</style><noscript><p>Turn it on, please.</p></noscript><!-- <p>hidden, too.</p> -->'
COOKIE = '<div id="cookieBanner"><p>We use cookies, for many things. Accept them, please, or do not; it is all the same.</p></div>'
COMMENTS = '<div class="comments-area"><h2>2 Comments</h2><ol><li><p>I liked it, very much. It was long, though; I read it twice.</p></li><li><p>Me, too, and I read it three times. Or was it four?</p></li></ol></div>'
SIDE = '<div class="sidebar"><p>Our letter, each week. It is free, and it is short; sign up.</p></div>'
FORM = '<form action="/q"><label>Your name, please.</label><input name=q><button>Send it.</button></form>'
LAYOUTS = {
    "article": f"<!DOCTYPE html><html><head><title>T</title>{JUNK}</head><body><header><p>Site, of all sites.</p></header><nav>{MENU}</nav><article>{ARTICLE}</article>{COOKIE}{COMMENTS}{FORM}<footer>&copy; Us, all of us.</footer></body></html>",
    "main": f"<body>{COOKIE}<div role=navigation>{MENU}</div><main><div class=ad>Buy, buy. Now, or later; but buy it.</div>{ARTICLE}{COMMENTS}</main>{SIDE}",
    "only divs": f'<html><body><div id="page"><div class="top-nav">{MENU}</div>{COOKIE}<div class="content">{ARTICLE}</div>{SIDE}{COMMENTS}<div id="footer">All rights, all of them, reserved.</div></div>',
    "no names": f"<body><div>{MENU}</div><div>{ARTICLE}</div><div>{MENU}</div></body>",
    "title outside": f'<body><div><div>{MENU}</div><div><h1>The title</h1><div>{ARTICLE.partition("</h1>")[2]}</div></div></div>',
    "inside": f'<body><article><header class="entry-header"><h1>The title</h1></header>{"".join(f"<p>{p}</p>" for p in PROSE[:3])}<aside>Aside, for once.</aside><div class="advert">An advert. It is here, in the text.</div>{"".join(f"<p>{p}</p>" for p in PROSE[3:])}{FORM}<p>Short.<section class="comments"><article class="comment"><p>A comment, as an article. It is of some length, as comments are.</p></article></section></article>',
    "tables": f"<body><table><tr><td>{MENU}</td><td>{ARTICLE}</td></tr></table></body>",
    "comments by heading": f"<body><article>{ARTICLE}<div><h3>Comments (2)</h3><p>I liked it, very much. It was long, though.</p></div></article></body>",
    "nav never closed": f"<body><nav>{MENU}<article>{ARTICLE}</article>",
    "unclosed formatting": "<body><article><h1>The title</h1>" + "".join(f"<p><b>{p}<br>" for p in PROSE) + "<p>Short.</article>",
}


@pytest.mark.parametrize("name", list(LAYOUTS))
def test_the_article_comes_whole_and_alone(name):
    assert main_text(LAYOUTS[name]) == WANT


def test_blocks_references_and_white_space():
    page = "<article><h1>A&amp;B &eacute;&#233;&#xE9; &lt;p&gt;</h1><p>one<b>two</b>\n three<br>four &nbsp; five<i> six</i></p>  loose, text\t<ul><li>x<li>y, and z.</ul><table><tr><td>1<td>2</table><pre>a\n  b</pre><p> </p><p>end &copy 1 < 2 & 3</article>"
    assert main_text(page) == "A&B ééé <p> onetwo three four five six loose, text x y, and z. 1 2 a b end © 1 < 2 & 3"


def test_pages_without_marks_or_punctuation():
    assert main_text("<p>the the the</p>") == "the the the"
    assert main_text("plain text, no tags.") == "plain text, no tags."
    assert main_text(f"<body><nav>{MENU}</nav></body>") == "" and main_text(JUNK) == ""
    assert [main_text(x) for x in (None, "", " \n", "<", "<p", "<!doctype html>", "<![endif]>x", "<![what[ x")] == ["", "", "", "<", "<p", "", "x", "<![what[ x"]


def test_deep_long_and_repetitive_pages():
    deep = "<div>" * 3000 + "<p>Down here, it is dark.</p>"
    assert main_text(deep) == "Down here, it is dark."
    long_ = "<article>" + "<p>Again, and again, a sentence.</p>" * 20_000 + "</article>"
    assert main_text(long_) == " ".join(["Again, and again, a sentence."] * 20_000)


def test_ratios_of_paths_tell_prose_from_lists():
    blocks = mainpart.blocks_of(mainpart.parse(LAYOUTS["no names"]))
    threshold = mainpart.score(blocks)
    of = {b.text: b for b in blocks}
    assert of["Short."].path == of[PROSE[0]].path and of["Short."].score >= threshold > of["Item 5"].score == 0


def test_over_a_table(spark):
    rows = [(1, "u", LAYOUTS["main"], "t"), (1, "u", LAYOUTS["main"], "t"), (None, None, None, None), (2, "v", "", "x"), (3, "w", "<p>Ünï, 🚖.</p>", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in mainpart.extract(pages).collect())
    assert got == sorted([(1, "u", WANT, len(WANT))] * 2 + [(0, None, "", 0), (2, "v", "", 0), (3, "w", "Ünï, 🚖.", 7)])
    assert mainpart.extract(pages.where("false")).collect() == [] and mainpart.extract(pages).columns == ["page_id", "url", "text", "n_chars"]


def test_batches_are_bounded_and_whole(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "u", f"<article><p>Page {i}, told.</p></article>") for i in range(1200)], "page_id long, url string, html string")
    assert {(r.page_id, r.text) for r in mainpart.extract(pages.coalesce(1)).collect()} == {(i, f"Page {i}, told.") for i in range(1200)}


def test_the_given_pages_give_their_articles(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in mainpart.extract(table).collect()}
    import html

    for r in table.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:h1|p)>", inner)]
        assert got[r.page_id] == " ".join(b for b in blocks if b)
