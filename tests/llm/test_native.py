"""URL filters, license scans and source mixing against brute force."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from siftlode.llm import bloom, licenses, mixing, urlfilter

URLS = [None, "", "no scheme", "http://", "http://Example.COM/en/1", "https://www.example.com/en/2?x", "http://a.www.example.com/en/", "http://x.net/es/1", "http://x.net/es", "http://x.net/fr/#", "http://net/fr/9", "http://notexample.com/en/1",
        "http://b.com", "http://b.com/", "ftp://b.com/q://z", "http://a.b.org/en/", "http://x.test/a", "https://localhost/", "http://e.com?u=/en/", "http://..com/", "http://example.com/EN/", "http://ex.com:80/en/", "HTTP://WWW.EXAMPLE.COM/en/x#y"]
RULES = dict(urlfilter.RULES)


def judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES for h, p in [(r[: r.index("/")], r[r.index("/"):])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fits, key=len, default=None)
    own = any((host == h or host.endswith("." + h)) and path.startswith("/") for h in ("test", "invalid", "localhost", "local"))
    return host, path, rule, RULES[rule] if rule else "block" if own else "allow"


def test_urls_against_brute_force(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS * 2)], "page_id long, url string, rule string")
    got = urlfilter.filter_urls(df).collect()
    assert len(got) == len(URLS) * 2
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == judge(URLS[r.page_id % len(URLS)])
    assert urlfilter.filter_urls(df.where(F.lit(False))).collect() == []


def test_lists_are_tables_and_long_hosts_have_few_keys(spark):
    rules = spark.createDataFrame([("b.c/", "block"), ("a.b.c/x/", "allow"), ("b.c/", "allow"), ("c/x/", "own"), (None, "block"), ("noslash", "block"), ("d/", "other")], "key string, side string")
    urls = ["http://" + "l." * 30_000 + "b.c/x", "http://a.b.c/x/y", "http://q.a.b.c/x/", "http://c/x/1", "http://b.c", "http://d/", None]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict, r.decided_by) for r in urlfilter.filter_urls(df, rules).collect()}
    assert got == {0: ("b.c/", "block", "rule"), 1: ("a.b.c/x/", "allow", "rule"), 2: ("a.b.c/x/", "allow", "rule"), 3: (None, "block", "reserved"), 4: (None, "allow", "default"), 5: (None, "allow", "default"), 6: (None, "allow", "default")}
    assert {r.verdict for r in urlfilter.filter_urls(df, rules.where("key is null")).collect()} == {"allow"}


def test_cascades_are_exact_over_their_universe(spark):
    u = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 97 == 3).alias("listed")).cache()
    levels = urlfilter.build_cascade(u, "listed")
    assert len(levels) > 1
    assert u.where(urlfilter.in_cascade(levels, F.col("key")) != F.col("listed")).count() == 0
    assert urlfilter.build_cascade(u.where("not listed"), "listed") == []
    with pytest.raises(OverflowError):
        bloom.Bloom(u, 10**9, 1e-6, 1)
    u.unpersist()


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


TEXTS = [None, "", "MIT License", "the mit license and Apache-License; general public license.", "mit mit license license", "GNU General  Public\nLicense version 3 mit license " * 3, "général public license", "mit licenses", "İMIT LICENSE",
         "Permission is hereby granted, free of charge, to any person obtaining a copy of this nice software and its associated documentation files", "under CC BY-NC 4.0: Licensed under CC BY-NC", "x " * 5000 + "apache license", "of the to the and the " * 50]


def test_license_places_against_brute_force(spark):
    df = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in licenses.license_report(df).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        w, r = words(t), got[i if i else None]
        at = [(k, label) for p, label in licenses.BASE_PHRASES for n in [len(p.split())] for k in range(len(w) - n + 1) if " ".join(w[k : k + n]) == p]
        places = [k for k, _ in at]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))), t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[9].labels == "mit" and not got[9].base_labels and "cc-by-nc" in got[10].labels.split(",") and got[12].labels == ""
    assert licenses.license_report(df.where(F.lit(False))).collect() == []


def test_a_passage_beside_repeated_pairs_is_found(spark):
    tail = " general public license" * 4
    df = spark.createDataFrame([(1, "gnu lesser general public license" + tail), (2, "general public license" + tail), (3, "gnu lesser general public license")], "doc_id long, text string")
    got = {r.doc_id: set(r.labels.split(",")) for r in licenses.license_report(df).collect()}
    assert got == {1: {"gpl", "lgpl"}, 2: {"gpl"}, 3: {"gpl", "lgpl"}}


def shares(sizes, weights, cap):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-9 and open_:
        unit = left / sum(w[s] for s in open_)
        left = 0.0
        for s in list(open_):
            target[s] += unit * w[s]
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                open_.discard(s)
    return target


@pytest.mark.parametrize("hot", [0.3, 0.9])
def test_mixing(spark, hot):
    rows = [(i, "w " * (1 + i * 7919 % 60), ["b", "Z", "é", None, "a", "tiny"][0 if (i * 31 % 100) / 100 < hot else 1 + i % 5], "x") for i in range(600)]
    rows += [(900, None, "b", "x"), (901, "", "empty", "x"), (None, "p q r", "a", "x"), (7, rows[7][1], rows[7][2], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for _, t, s, _ in rows:
        size[s] += len((t or "").split())
    target = shares(size, (5, 2, 1), 3)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source]) and 0 <= r.taken <= 3 * r.size and r.taken == r.size * r.repeats
        taken[r.source] += r.taken
    for s in size:
        assert abs(taken[s] - target[s]) <= 61, (s, taken[s], target[s])
    assert sorted(map(str, mixing.mix(df).collect())) == sorted(map(str, got))
    assert mixing.mix(df.where(F.lit(False))).collect() == []


def test_a_row_is_repeated_by_its_own_source_only(spark):
    rows = [(1, "w " * 50, "a", 0), (1, "w " * 50, "b", 1), (2, "v " * 4000, "b", 1), (3, "u " * 2000, "c", 2), (4, None, None, 3), (None, "", "a", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, h int")
    want = {(r.doc_id, r.source): r.repeats for r in mixing.mix(df).collect()}
    got = mixing.mixed(df)
    assert got.columns == df.columns
    have = defaultdict(int)
    for r in got.collect():
        have[r.doc_id, r.source] += 1
    assert dict(have) == {k: n for k, n in want.items() if n} and max(have.values()) <= 3 and want[1, "a"] != want[1, "b"]


def test_sources_are_numbered_by_code_points(spark):
    names = [f"s{i:03d}" for i in range(200)] + ["", "Z", "é", "a", None]
    df = spark.createDataFrame([(n, 1) for n in reversed(names)], "source string, source_size long").repartition(7)
    got = {r.source: r.n for r in mixing.numbered(df).collect()}
    assert got == {s: i for i, s in enumerate([*sorted(names[:-1]), None])}
