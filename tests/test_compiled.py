"""Rules as columns against the same rules in Python, over generated bodies and patterns."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from siftlode.functions.text import regex_replace, replacement, web_regex
from siftlode.rules import frames
from siftlode.rules.compiled import compiled, steps_of
from siftlode.rules.engine import Document, kind_of, number_text, replace, run, text_of

PATHS = [
    "@json:$", "$.a", "$.a.b", "$['a']['b c']", "$.a[0]", "$.a[-1]", "$.a[1].b", "$.a[*]", "$.a[*].b", "$.a[*].b[*]", "$.*", "$.a.*", "$.a[0:2]", "$.a[-2:]", "$.a[1:-1].b", "$.a[:1][*]", "$[0]", "$[*].a", "$[-1:].a[0]", "@Json:$.b", "$.é", "$.a[*][0]",
    "$.a && $.b", "$.nope || $.a || $.b", "$.a[*] %% $.b[*]", "$.a[*].b##n(.)##<$1>", "$.b##^x##", "$.nope",
]
VALUES = [None, True, False, 0, -7, 12345678901, 2**70, 1.5, 2.0, -0.0, 0.1, 1e5, 1e-7, 2.5e-6, 1e22, 123456.789, "", "x", "ein e", "é\"\\\n", "3", '{"b":1}', [], {}]
KEYS = ["a", "b", "b c", "é", "z"]


def body(rng, depth=0):
    pick = rng.random()
    if depth > 3 or pick < 0.35:
        return rng.choice(VALUES)
    if pick < 0.65:
        return [body(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {k: body(rng, depth + 1) for k in rng.sample(KEYS, rng.randrange(1, 5))}


def plain(text):
    """Nested floats are written by two libraries, of which only values count."""
    try:
        return json.loads(text) if text[:1] in "[{" else text
    except ValueError:
        return text


def test_compiled_rules_select_what_python_selects(spark):
    rng = random.Random(5)
    bodies = [json.dumps(body(rng), ensure_ascii=rng.random() < 0.5) for _ in range(400)] + ["", "nope", "[1", '{"a":1,"a":2}', "NaN", " [1] ", '"x"', "[[[[[1]]]]]", None]
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    assert all(steps_of(p) for p in PATHS)
    got = df.select("id", *[compiled(p, F.col("body")).alias(f"r{k}") for k, p in enumerate(PATHS)]).collect()
    assert len(got) == len(bodies)
    for r in got:
        for k, p in enumerate(PATHS):
            want = [(kind_of(x), text_of(x)) for x in run(p, Document(bodies[r.id]))]
            have = [(x.kind, x.text) for x in r[f"r{k}"]]
            assert [(a, plain(b)) for a, b in have] == [(a, plain(b)) for a, b in want], (p, bodies[r.id])


def test_rules_that_need_python_go_there(spark):
    for rule in ("$..a", "$.a[?(@.b > 1)]", "$.a['it\\'s']", "a@text", "//a", "$.a && li", "$.a##(?<n>x)##", "$.a[", "@js:1", ""):
        assert steps_of(rule) is None
    df = spark.createDataFrame([(1, '{"a":[{"b":2},{"b":1}]}'), (2, None)], "page_id int, html string")
    plan = lambda rule: frames.apply_rule(df, rule)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan("$.a[*].b") and "MapInArrow" in plan("$..b")
    assert sorted(map(tuple, frames.apply_rule(df, "$.a[*].b").collect())) == sorted(map(tuple, frames.apply_rule(df, "$..b").collect())) == [(1, 0, "number", "2"), (1, 1, "number", "1")]


def test_long_and_deep_bodies(spark):
    long_ = json.dumps({"a": [{"b": i, "c": "x" * 50} for i in range(20_000)]})
    deep = "[" * 400 + "1" + "]" * 400
    df = spark.createDataFrame([(1, long_), (2, deep)], "page_id int, html string")
    got = frames.apply_rule(df, "$.a[*].b").collect()
    assert [r.text for r in sorted(got, key=lambda r: r.ord)] == [str(i) for i in range(20_000)]
    assert frames.apply_rule(df, "$[0][0][0]").count() == 1


@pytest.mark.parametrize("x,want", [(1, "1"), (1.0, "1"), (-0.0, "0"), (1e5, "100000"), (0.1, "0.1"), (1e21, "1e+21"), (1.5e22, "1.5e+22"), (1e-7, "1e-7"), (1.25e-9, "1.25e-9"), (0.000001, "0.000001"), (123456.789, "123456.789"), (10**20, "1" + "0" * 20)])
def test_numbers_are_written_as_on_the_web(x, want):
    assert number_text(x) == want


PATTERNS = [
    ("e(.)", "<$1>"), (r"\d+", "#"), (r"[\d.]+", "n"), (r"\bthe\b", "$&$&"), (r"\s+", " "), (r"[^\s]+$", "[$&]"), ("^.", "^"), ("a|b|", "-"), ("x{2,}", "y"), ("{", "$"), (r"(a)(b)?", "$2$1$3"), (r"\w+?e", "$$1"), ("(?=a)", "!"), (r"[a-c\]]", r"\1"), ("<.*?>", ""),
    ("[&&]", "+"), (r"é|\x41", "u"), ("(?!a)[a-z]", "_"), ("[一-鿿]", "C"),
]
TEXTS = ["", "the axe and theory 12.5 é", "aab{xxx}xx\n<b>A b</b> end", "a&&b] $1 中文 \u0085 x", "\r\nab", "٣ 3 ß the"]


def test_replacements_agree_between_java_and_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, t string")
    cols = [regex_replace(F.col("t"), p, to, first).alias(f"c{k}_{int(first)}") for k, (p, to) in enumerate(PATTERNS) for first in (False, True)]
    for r in df.select("id", *cols).collect():
        for k, (p, to) in enumerate(PATTERNS):
            for first in (False, True):
                assert r[f"c{k}_{int(first)}"] == replace(TEXTS[r.id], ((p, to, first),)), (p, to, first, TEXTS[r.id])


def test_what_is_not_translated():
    for p in ("(?<n>a)", "(?<=a)b", r"\p{L}", "(?i)a", "a++", "[", "(", "[]a]", r"\k<n>", r"[\D]"):
        assert web_regex(p) is None
    assert replacement("$1$2$$$&$", 1) == ["$" if x == "$$" else x for x in (1, "$2", "$$", 0, "$")]
    assert re.fullmatch(web_regex(r"a$"), "a") and not re.search(web_regex("a$"), "a\n")


def test_a_pattern_that_backtracks_without_end_is_given_up():
    text = "a" * 40 + "!"
    assert replace(text, (("(a+)+$", "x", False),)) == text
