import json

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st

from siftlode.plans import registry
from siftlode.rules.dom import parse
from siftlode.rules.engine import Document, first_text, read_rule, resolve, run, text_of
from siftlode.rules.select import BadRule

HTML = """<div id=top><ul class="result-list"><li class="book"><a class="name" href="/b/1">One</a><span class=author>A</span>
<li class="book odd"><a class="name" href="/b/2">Two</a><span class=author>B</span></ul><p>first<p>second<script>var t="</p>";</script><div id="content">long text here</div></div>"""
STORE = json.dumps({"store": {"book": [{"title": "x", "price": 8, "author": "q"}, {"title": "y", "price": 20}]}, "data": [{"name": "n1", "url": "/u1"}]})


def texts(rule, body=HTML):
    return [text_of(x) for x in run(rule, Document(body))]


@pytest.mark.parametrize("rule,want", [
    (".result-list .book a@text", ["One", "Two"]), (".name@href", ["/b/1", "/b/2"]), ("li.book > a.name!1@text", ["Two"]), ("li:last-child@tag:span@text", ["B"]), ("li:nth-child(2n+1) a", ["One"]), ("li:not(.odd) .author", ["A"]),
    ("a[href$='2']", ["Two"]), ("p", ["first", "second"]), ("//li[2]/a/@href", ["/b/2"]), ("@XPath://span[@class='author']/text()", ["A", "B"]), (".nope || .name", ["One", "Two"]), (".name || .author", ["One", "Two"]),
    (".name@text && .author@text", ["One", "Two", "A", "B"]), (".name@text %% .author@text", ["One", "A", "Two", "B"]), (".name@text##O(n)##$1-", ["n-e", "Two"]), (".name@text##e##", ["On", "Two"]), ("class.book-list", []), ("p + p", ["second"]), ("ul ~ p", ["first", "second"]),
    ("#content:contains(text)", ["long text here"]), ("a.name!-1@href", ["/b/2"]), ("li@put:{x}@a@text && @get:{x}", ["One", "Two", "OneA"]),
])
def test_document_rules(rule, want):
    got = texts(rule)
    assert got == want


@pytest.mark.parametrize("rule,want", [
    ("$.store.book[*].title", ["x", "y"]), ("$..title", ["x", "y"]), ("$.store.book[-1].price", ["20"]), ("$.store.book[?(@.price < 10)].title", ["x"]), ("$.store.book[0:1].author", ["q"]), ("@Json:$['data'][0].name", ["n1"]), ("$.none", []),
])
def test_json_rules(rule, want):
    assert texts(rule, STORE) == want


def test_scope():
    doc = Document(STORE)
    item = run("$.data[*]", doc)[0]
    assert first_text("$.name", doc, item) == first_text("name", doc, item) == "n1" and first_text("@href", doc, item) == "/u1"
    page = Document(HTML)
    li = run("li", page)[1]
    assert first_text("a@href", page, li) == "/b/2" and first_text("li.odd@text", page, li) == "TwoB" and first_text(".author@text##B##C", page, li) == "C"


def test_scripts_are_refused():
    for rule in ("@js:java.ajax(x)", "<js>1</js>", "a:hover", "//a[position()<2]"):
        with pytest.raises(BadRule):
            run(rule, Document(HTML))


def test_resolve():
    assert resolve("/x", "https://a.b/c/d") == "https://a.b/x" and resolve("e", "https://a.b/c/d") == "https://a.b/c/e" and resolve("//q.w", None) == "https://q.w"
    assert resolve("site.org/1", None) == "https://site.org/1" and resolve("", "https://a.b") is None and resolve("x y", None) is None


@given(st.text(max_size=300))
def test_any_text_parses(text):
    assert isinstance(parse(text).text(), str)


@given(st.text(alphabet="ab.#>@|&%[]'$!:()1 ", max_size=30))
def test_any_rule_reads_or_is_refused(rule):
    try:
        read_rule(rule)
        run(rule, Document(HTML))
    except BadRule:
        pass


def test_rows_that_ask_the_same_of_a_page_share_its_parse():
    from siftlode.rules.frames import Remembered

    calls = []
    told = Remembered(lambda *x: calls.append(x) or len(calls))
    rows = [("<p>x</p>", "p", "u", "text")] * 1000 + [("<p>x</p>", "p", "u", "href")] * 3 + [("<p>x</p>", "p", "v", "text")] * 2 + [("<p>y</p>", "p", "v", "text"), (None, "p", "v", "text")]
    assert [told(*r) for r in rows] == [1] * 1000 + [2] * 3 + [3] * 2 + [4, None] and len(calls) == 4


def test_a_worker_takes_few_pages_at_a_time(spark):
    """Pages of 40 KB, a null one and an unreadable rule among them."""
    from pyspark.sql import functions as F

    from siftlode.rules import frames

    page = F.concat(F.lit("<ul><li>"), F.col("id").cast("string"), F.lit("<li>b</ul>"), F.repeat(F.lit("x"), 40_000))
    pages = spark.range(2000).coalesce(1).select("id", F.when(F.col("id") != 7, page).alias("page"))
    ask = lambda: frames.extract_one(pages, F.when(F.col("id") == 8, "li[").otherwise("li"), {"a": F.lit("text"), "b": F.lit("java.x")}, "page", F.lit(None).cast("string"))
    got = {r.id: r.got for r in ask().where("id < 10").collect()}
    assert ask().columns == ["id", "got"] and sorted(got) == [*range(10)] and (got[7] is None or got[7].n is None)
    assert (got[8].n, got[8].error, got[8].first.a) == (0, "unsupported_rule_syntax", None)
    assert (got[9].n, got[9].error, got[9].first.a, got[9].some.a, got[9].first.b) == (2, "unsupported_rhino_api", "9", "9", None)

    plan = ask()._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "MapInArrow" not in plan  # a hundred rows at a time, not an Arrow batch of whole rows


def test_references_without_a_semicolon_can_stay(spark, tmp_path):
    titles = ["x &amp;&amp", "&lt;b&gt &quot", "&ampx; &nope; &am", "a && b &copy=1", "&amp;lt;", "&quot;q&quot;", "plain"]
    rows = [(i, f"<html><title>{t}</title><script>a && b&lt</script></html>") for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = sorted(map(tuple, registry.QUERIES["html_title"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(registry.ORACLE_SQL["html_title"]).fetchall()) and got[0][2] == "x &&amp"
    # a browser's reading stays the default
    assert Document(rows[0][1]).root().text() == "x &&" and "a && b&lt</script>" in Document(rows[0][1], open_references=False).root().html()
