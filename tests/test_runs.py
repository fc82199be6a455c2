import json

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from siftlode.plans import registry
from siftlode.plans.process import Options, process
from siftlode.functions.plan import numbered
from siftlode.operators import probes
from siftlode.plans import process as plan
from siftlode.rules.chain import batch_results, final_result, verify_chain
from siftlode.sources import results, sinks
from siftlode.sources.catalog import landed, page_store, read_catalog, safe_file_name, safe_input, safe_output
from siftlode.streaming import incremental

SF = "/root/testdata/sf0.001"
AS_OF = 1_767_225_600_000


def record(i, name, url, **more):
    rules = {"searchUrl": "/s?q={{key}}", "ruleSearch": {"bookList": "li", "name": "a@text", "bookUrl": "a@href"}, "ruleBookInfo": {"name": "h1@text", "tocUrl": "a.toc@href"}, "ruleToc": {"chapterList": ".chapter a", "chapterName": "text", "chapterUrl": "href"}, "ruleContent": {"content": "#content@text"}}
    return {"bookSourceName": name, "bookSourceUrl": url, "bookSourceGroup": "小说", "bookSourceType": 0, "enabled": True, "customKey": {"n": i}, **rules, **more}


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    rows = [
        record(0, "🚖 橘子湾", "https://www.site0.com"), record(1, "青石书屋@阿远", "https://www.qingshi-shuwu.com"), record(2, "青石书屋", "https://m.qingshi-shuwu.com", respondTime=200), record(3, "✨失效屋✨", "https://dead.com", ruleBookInfo=None, ruleToc=None),
        record(4, "文集下载屋", "https://dl.com", bookSourceType=3, ruleSearch={}), record(5, "非HTTP", "custom-id", enabled=False), record(6, "复杂", "https://c.com", searchUrl="@js:java.ajax(1)", weight="heavy"),
    ]
    path = tmp_path_factory.mktemp("c") / "catalog.json"
    path.write_text(json.dumps(rows, ensure_ascii=False))
    return read_catalog(spark, str(path))


def test_reading_keeps_order_unknown_keys_and_issues(spark, catalog, tmp_path):
    rows = catalog.orderBy("idx").collect()
    assert [r.idx for r in rows] == list(range(7)) and rows[4].rs_keys == 0 and rows[3].bi_keys is None and rows[0].rs_keys == 3 and rows[6].issues == ["weight: not double"]
    (tmp_path / "bad.json").write_text('{"a": 1}')
    with pytest.raises(Exception, match="root of a catalog"):
        read_catalog(spark, str(tmp_path / "bad.json")).collect()


def test_what_lands_is_judged_before_it_is_read(spark, tmp_path):
    import os

    for i, (name, text) in enumerate([("a b.json", "[]"), ("b.json", "[1, 2]"), ("c.JSON", '[{"x": 1}]'), ("d.json", '{"not": "an array"}'), ("e.json", "[" + "1," * 500 + "1]"), ("f.txt", "[]"), ("g.json", "[oops")]):
        (tmp_path / name).write_text(text)
        os.utime(tmp_path / name, (1000 + i, 1000 + i))
    got = {r.name: r.verdict for r in landed(spark, str(tmp_path), most=500, newest=2).collect()}
    assert got == {"a_b.json": "evicted", "b.json": "accepted", "c.JSON": "accepted", "d.json": "unreadable", "e.json": "too_large", "f.txt": "not_json", "g.json": "unreadable"}


def test_process_writes_and_checks(catalog, tmp_path):
    r = process(catalog, Options(as_of=AS_OF, dedupe_level="host", include_unknown=True, write_meta=True, group_mode="overwrite"))
    rows = {x.idx: x for x in r.reviewed.collect()}
    assert len(rows) == 7 and rows[5].removed_reason == "Filtered: disabled source excluded" and rows[1].removed_reason.startswith('Duplicate of "青石书屋"') and rows[2].kept
    assert all(c["pass"] for c in r.checks().collect())
    r.write(f"file://{tmp_path}/out")
    kept = [json.loads(x) for p in (tmp_path / "out/cleaned-sources").glob("part-*") for x in p.read_text().splitlines()]
    assert {k["originalIndex"] for k in kept} == {i for i, x in rows.items() if x.kept} and all(k["customKey"]["n"] == k["originalIndex"] and k["bookSourceName"] for k in kept)
    assert (tmp_path / "out/reports/report.html").read_text().startswith("<!doctype html>") and list((tmp_path / "out/groups").glob("file_key=*"))
    head = next((tmp_path / "out/reports/sources.csv").glob("part-*.csv")).read_text().splitlines()[0]
    assert head.startswith("index,originalName,cleanedName")


def test_written_output_is_checked_and_read_again(spark, catalog, tmp_path):
    for meta in (True, False):
        out = f"file://{tmp_path}/out{meta}"
        r = process(catalog, Options(as_of=AS_OF, dedupe_level="host", include_unknown=True, write_meta=meta, group_mode="overwrite"))
        r.write(out)
        assert all(c["pass"] for c in r.verify(out).collect())
        kept = {x.idx for x in r.kept.collect()}
        cleaned, groups = r.written(out)
        assert {x.idx for x in cleaned.collect()} == {x.idx for x in groups.collect()} == kept
        parts = sorted((tmp_path / f"out{meta}" / "cleaned-sources.json").glob("part-*"))
        array = json.loads("".join(p.read_text() for p in parts))
        assert len(array) == len(kept) and [x["customKey"]["n"] for x in array] == sorted(kept)
        assert results.summary(spark, out)["output_total"] == len(kept) and results.summary(spark, f"{out}-none") is None
        assert results.source(spark, out, 1)["removed_reason"].startswith("Duplicate of") and results.source(spark, out, 99) is None
        found = results.issues(spark, out)
        assert found["output-consistency"].count() == 16 and found["duplicates"].first().removed_indices == [1] and found["duplicate_risks"].count() == 0
        with pytest.raises(ValueError):
            results.report(spark, out, "../x")
        r.release()
    # a record is taken out of one file, renamed in another
    lost = next((tmp_path / "outTrue/groups").glob("file_key=*/part-*.txt"))
    lines = lost.read_text().splitlines()
    lost.write_text("\n".join([json.dumps(json.loads(lines[0]) | {"bookSourceName": "🚖 changed 优++"}, ensure_ascii=False), *lines[2:]]) + "\n")
    for crc in lost.parent.glob(".*.crc"):
        crc.unlink()
    r = process(catalog, Options(as_of=AS_OF, dedupe_level="host", include_unknown=True, write_meta=True, group_mode="overwrite"))
    bad = {c["id"] for c in r.verify(f"file://{tmp_path}/outTrue").where("not pass").collect()}
    assert {"same-index-same-fields", "dirty-names-in-groups"} <= bad and (len(lines) < 2 or {"groups-total-equals-cleaned", "index-sets-match"} <= bad)


def test_modes_of_validation(catalog):
    assert probes.validate_mode(" Deep ") == "deep" and probes.validate_mode("typo") is probes.validate_mode(None) is probes.validate_mode("") is None
    with pytest.raises(ValueError, match="typo"):
        process(catalog, Options(as_of=AS_OF, validate_mode="typo"))
    with pytest.raises(ValueError, match="pages"):
        process(catalog, Options(as_of=AS_OF, validate_mode="deep"))


def test_fetching_checks_each_hop_and_tries_again(spark):
    def fetch(url, method, body, headers):
        import os
        import tempfile

        if url.endswith("/once"):  # fails the first time
            mark = os.path.join(tempfile.gettempdir(), f"{os.getpid()}-{headers['run']}")
            if not os.path.exists(mark):
                open(mark, "w").close()
                raise TimeoutError("timed out")
        if url.endswith("/slow"):
            raise TimeoutError("timed out")
        if url.endswith("/gone"):
            raise OSError("getaddrinfo ENOTFOUND")
        if url.endswith("/loop"):
            return 302, None, None, "/loop"
        if url.endswith("/in"):
            return 301, None, None, "http://127.0.0.1/secret"
        if url.endswith("/moved"):
            return 308, None, None, "//b.example.org/here"
        if url.endswith("/found"):
            return 302, None, None, "/ok"
        return (404 if url.endswith("/missing") else 200), "text/html", f"{method} {url} {body}", None

    cases = ["/ok", "/once", "/slow", "/gone", "/loop", "/in", "/moved", "/missing", "/found"]
    asked = spark.createDataFrame([(i, f"https://a.example.org{p}", "POST", "q", {"run": str(AS_OF)}) for i, p in enumerate(cases)] + [(20, "http://[::1]/", "GET", None, {}), (21, "http://printer.local", "GET", None, {}), (22, "http://inner.example.org", "GET", None, {}), (23, "nonsense", "GET", None, {})], "idx long, url string, method string, body string, headers map<string,string>").coalesce(1)
    resolve = lambda host: ["10.0.0.7"] if host.startswith("inner") else ["93.184.216.34"]
    done = probes.fetch_with(asked, fetch, workers=1, resolve=resolve).persist()
    got = {r.idx: (r.status, r.error, r.hops, r.attempts) for r in done.collect()}
    assert [got[i] for i in range(8)] == [(200, None, 0, 1), (200, None, 0, 2), (None, "timeout", 0, 2), (None, "dns_failed", 0, 1), (302, None, 5, 1), (None, "ssrf_blocked", 1, 1), (200, None, 1, 1), (404, None, 0, 1)]
    assert {got[i][1] for i in (20, 21, 22, 23)} == {"ssrf_blocked"}
    assert done.where("idx = 6").first().page == "POST https://b.example.org/here q" and done.where("idx = 8").first().page == "GET https://a.example.org/ok None"
    said = {r.idx: r.connectivity for r in probes.connectivity(done).collect()}
    assert [said[i] for i in (0, 2, 3, 4, 5, 7)] == ["CONNECT_OK", "CONNECT_TIMEOUT", "CONNECT_ERROR", "CONNECT_OK", "CONNECT_ERROR", "CONNECT_DEAD"]
    done.unpersist()


def test_a_host_never_has_more_requests_at_once_than_allowed(spark, tmp_path):
    """A fetcher that notes when it began and ended, over all tasks."""
    folder = str(tmp_path)

    def fetch(url, method, body, headers):
        import time
        import uuid

        began = time.time()
        time.sleep(0.02)
        host = url.split("/")[2]
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(f"{host} {began} {time.time()}")
        return (307, None, None, "http://hot.example.org/end") if url.endswith("/hop") else (200, None, "x" * 10, None)

    rows = [(i, f"http://hot.example.org/{i}", "GET", None) for i in range(120)] + [(200 + i, f"http://h{i % 20}.example.org/{i}", "GET", None) for i in range(60)]
    asked = spark.createDataFrame(rows, "idx long, url string, method string, body string").repartition(8)
    got = probes.fetch_with(asked, fetch, per_host=3, tasks=8).collect()
    assert len(got) == 180 and all(r.status == 200 for r in got)
    spans = [x.read_text().split() for x in tmp_path.iterdir()]
    for host in {s[0] for s in spans}:
        marks = sorted([(float(a), 1) for h, a, _ in spans if h == host] + [(float(b), -1) for h, _, b in spans if h == host])
        at = most = 0
        for _, step in marks:
            at += step
            most = max(most, at)
        assert most <= 3, host
    one = spark.createDataFrame([(1, "http://a.example.org/hop", "PUT", "q")], asked.schema)
    assert probes.fetch_with(one, fetch, per_host=1).first().hops == 1


def test_pace_deadline_and_bytes(spark):
    now, slept = [0.0], []
    pace = probes.HostPace(2, 0.5, clock=lambda: now[0], sleep=slept.append)
    for _ in range(3):
        with pace.turn("h"):
            pass
    with pace.turn("other"):
        pass
    assert slept == [0.5, 1.0]
    assert probes.cut_bytes("é" * 10, 7) == "ééé" and probes.cut_bytes("abc", 7) == "abc" and probes.cut_bytes(None, 7) is None

    def fetch(url, method, body, headers):
        import time

        time.sleep(0.15)
        return 302, None, None, "/next"

    late = spark.createDataFrame([(1, "http://a.example.org/", "GET", None)], "idx long, url string, method string, body string")
    assert probes.fetch_with(late, fetch, deadline=0.2).first().error == "timeout"


def test_an_array_without_rows_is_an_array(spark, tmp_path):
    sinks.write_array(spark.createDataFrame([], "idx long, json string"), str(tmp_path / "none.json"))
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "none.json").glob("part-*")))) == []


def test_hosts_of_this_network():
    for url in ("http://localhost:8080", "https://x.local/", "http://0.0.0.0", "http://[fd00::1]/", "http://[::ffff:192.168.0.1]", "http://169.254.1.1", "x", "http://"):
        assert probes.refused(url), url
    for url in ("http://fcbooks.com", "https://fdnovel.net/a", "http://8.8.8.8", "http://[2001:db8::1]/", "http://localhost.example.org"):
        assert not probes.refused(url), url


def test_entry_points(spark, catalog, tmp_path):
    tables = plan.inspect(catalog)
    assert tables["flags"].first().records == 7 and {r.host for r in tables["duplicate_hosts"].collect()} == {"qingshi-shuwu.com"}
    plan.split(catalog, Options(as_of=AS_OF), f"file://{tmp_path}/s")
    assert sum(len(p.read_text().splitlines()) for p in (tmp_path / "s/groups").glob("file_key=*/part-*.txt")) == 7
    store = page_store(spark.createDataFrame([("https://none.example.org", "x")], "url string, html string"))
    assert plan.validate(catalog, Options(as_of=AS_OF, include_unknown=True), store).count() > 0
    assert [r.stage for r in plan.debug(catalog, store, 0, keyword="k").collect()] == ["search"]


def test_nothing_stays_persisted_after_a_run_is_released(spark, catalog, tmp_path):
    held = lambda: set(spark.sparkContext._jsc.getPersistentRDDs().keySet().toArray())
    before = held()
    r = process(catalog, Options(as_of=AS_OF, dedupe_level="host", include_unknown=True))
    r.write(f"file://{tmp_path}/o")
    assert r.groups.count() == 1 and held() - before
    r.release()
    assert held() <= before


def test_what_a_search_probe_finds_reaches_the_run(spark, catalog):
    store = page_store(spark.createDataFrame([(f"https://www.site0.com/s?q={'%E6%96%97%E7%A0%B4%E8%8B%8D%E7%A9%B9'}", "<li>" + "x" * 300)], "url string, html string"))
    asked = []

    def respond(requests):
        asked.extend(r.idx for r in requests.collect())
        return probes.stored_responses(store)(requests)

    found = {r.idx: r for r in probes.search_probe(catalog, respond).collect()}
    assert found[6].search_status == "SEARCH_COMPLEX_JS_SKIPPED" and found[5].search_status == "SEARCH_SKIPPED_NON_HTTP" and sorted(set(asked)) == [0, 1, 2, 3, 4]
    assert found[0].search_status == "SEARCH_RULE_LIKELY_OK" and found[1].search_status == "SEARCH_FAILED" and not found[6].asked
    sites = spark.createDataFrame([(0, 200, None, 12), (1, 404, None, 30)], "idx long, status int, error string, ms long")
    both = probes.probed(probes.connectivity(sites), probes.search_probe(catalog, probes.stored_responses(store)))
    rows = {r.idx: r for r in process(catalog, Options(as_of=AS_OF), connectivity=both).reviewed.collect()}
    assert rows[0].availability == "usable" and rows[1].availability == "dead" and rows[6].search_status == "SEARCH_COMPLEX_JS_SKIPPED"


def test_numbers_inside_names_sort_by_value(spark):
    from siftlode.functions.text import natural_key

    names = [None, "", "a", "A1", "a2", "a02", "a10", "a10b", "a" + "9" * 40, "b", "2", "10", "第2章", "第10章"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    got = [r.n for r in df.where("n is not null").orderBy(natural_key(F.col("n")), "i").collect()]
    assert got == ["", "2", "10", "a", "A1", "a2", "a02", "a10", "a10b", "a" + "9" * 40, "b", "第2章", "第10章"]


def test_numbers_follow_the_order_over_partitions(spark):
    df = spark.range(0, 1000, 1, 9).select((F.col("id") * 7919 % 1000).alias("x"))
    got = {r.x: r.n for r in numbered(df, "x").collect()}
    assert got == {i: i for i in range(1000)}


def test_large_groups_are_listed_in_parts(spark, monkeypatch):
    from siftlode.operators import dedupe
    from siftlode.plans.testdata import judged

    monkeypatch.setattr(dedupe, "LISTED", 2)
    m = dedupe.dedupe(judged(spark, SF), "host").persist()
    rows = dedupe.listed(m, dedupe.groups(m, "host")).collect()
    sizes = {r.dedupe_key: r.size for r in dedupe.groups(m, "host").collect()}
    assert max(sizes.values()) > 3 and any(r.part for r in rows)
    assert sum(len(r.diffs) for r in rows) == sum(n - 1 for n in sizes.values())
    m.unpersist()


def test_a_group_of_many_parts_is_one_row(spark, monkeypatch):
    from siftlode.operators import dedupe

    monkeypatch.setattr(dedupe, "LISTED", 2)
    test_query_equals_its_sql(spark, "dedupe_groups_host")


def test_removed_members_stand_in_order_over_parts(spark, monkeypatch):
    from siftlode.operators import dedupe
    from siftlode.plans.testdata import judged

    monkeypatch.setattr(dedupe, "LISTED", 2)
    df = judged(spark, SF).withColumns({"url": F.when(F.col("idx") % 3 > 0, F.concat(F.lit("https://a.org/"), F.col("idx"))).otherwise(F.col("url")), "type": F.lit(0), "category": F.lit("x")})
    m = dedupe.dedupe(df, "host").persist()
    want = {}
    for r in dedupe.ranked(m.where("dup_size > 1")).orderBy("dup_rank").collect():
        want.setdefault(r.dedupe_key, []).append(str(r.idx))
    got = dedupe.removed(m).collect()
    assert max(map(len, want.values())) > 30 and {r["__key"]: r.removed for r in got} == {k: ",".join(v[1:]) for k, v in want.items()} and len(got) == len(want)
    m.unpersist()


def test_literal_behaviour_of_prefilters(catalog):
    r = process(catalog, Options(as_of=AS_OF, dedupe_level="exact", respect_prefilters=False, include_unknown=True, include_unavailable=True))
    assert r.reviewed.where("idx = 5").first().kept


def test_chain_follows_four_pages(spark, catalog):
    search = "https://www.site0.com/s?q=%E6%96%97%E7%A0%B4%E8%8B%8D%E7%A9%B9"
    pad = "<p>" + "x" * 60 + "</p>"
    pages = [(search, f"<ul><li><a href='/b/1'>T</a></li></ul>{pad}"), ("https://www.site0.com/b/1", f"<h1>Title</h1><a class=toc href='/t'>go</a>{pad}"), ("https://www.site0.com/t", f"<div class=chapter><a href='/c/1'>C1</a></div>{pad}"), ("https://www.site0.com/c/1", f"<div id=content>{'word ' * 20}</div>{pad}")]
    store = page_store(spark.createDataFrame(pages, "url string, html string"))
    one = catalog.withColumn("category", F.lit("小说"))
    got = {(r.idx, r.stage): (r.status, r.reason) for r in verify_chain(one, store).collect()}
    assert [got[0, s] for s in ("search", "bookInfo", "toc", "content")] == [("PASS", None)] * 4
    assert got[1, "search"] == ("FAIL", "network_error") and got[4, "search"] == ("SKIPPED", None) and (1, "toc") not in got
    rows = {r.stage: r for r in verify_chain(one.where("idx = 0"), store).collect()}
    assert rows["search"].detail["book_url"] == "https://www.site0.com/b/1" and rows["bookInfo"].suggestion is None and rows["content"].suggestion.startswith("The text has fewer") and "content" not in rows["content"].detail
    assert {r.idx: r.summary for r in final_result(verify_chain(one, store), one).collect()}[0] == "🚖 橘子湾: 4/4 stages passed"
    p = process(catalog, Options(as_of=AS_OF, include_unknown=True, validate_mode="deep"), pages=store)
    wide = sinks.with_batch(p.reviewed, p.batch)
    assert wide.where("idx = 1").select("batch_mode", "batch_status").first() is not None and wide.where("idx = 2").first().first_failure_stage == "search" and p.top_reasons().first().reason == "network_error"
    assert {r.idx: r.status for r in p.batch.collect()}[0] == "PASS"
    short = page_store(spark.createDataFrame([*pages[:3], (pages[3][0], f"<div id=content>x</div>{pad}")], "url string, html string"))
    assert {r.stage: r.reason for r in verify_chain(one.where("idx = 0"), short).collect()}["content"] == "content_too_short"
    assert batch_results(p.reviewed, None).count() == 7


def test_times_of_any_year_are_shown(spark):
    from siftlode.functions import times

    at = [0, -1, AS_OF, -62_167_219_200_000, -62_167_219_200_001, -62_236_339_200_000, -99_999_999_999_999, 253_402_300_799_999, 253_402_300_800_000, -9_000_000_000_000_001, 1_711_850_400_000, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(at)], "i int, t long")
    want = [(x and x[0]) or "N/A" for x in (duckdb.sql(f"select strftime(make_timestamp({'null' if t is None else t}::bigint * 1000), '%Y-%m-%d %H:%M:%S')").fetchall()[0] for t in at)]
    try:
        for zone in ("UTC", "America/New_York", "Europe/Berlin"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert [r.s for r in df.select("i", times.shown(F.col("t")).alias("s")).orderBy("i").collect()] == want
            # beyond what a timestamp holds
            assert spark.range(1).select(times.shown(F.lit(-(10**17)))).first()[0] == str(-(10**17))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_paths(tmp_path):
    assert safe_output("output-1/x") == "output-1" and safe_file_name("a b/中.json") == "a_b__.json"
    for bad in ("../x", "etc/x", "a\x00.json"):
        with pytest.raises(ValueError):
            safe_input(bad, str(tmp_path))
    assert safe_input("samples/a.json", str(tmp_path)).endswith("samples/a.json")


def test_streaming_counts_equal_the_batch(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(2).write.parquet(str(tmp_path / "in"))
    q = incremental.progress(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), delay="3650 days").writeStream.outputMode("complete").format("memory").queryName("live").start()
    q.processAllAvailable()
    q.stop()
    want = e.groupBy(F.window("ts", "5 minutes"), "event_type").count().count()
    assert spark.table("live").count() == want and incremental.percent(100) == 90


def canonical(df):
    def show(v):
        if hasattr(v, "tolist") and not hasattr(v, "isoformat"):
            v = v.tolist()
        if isinstance(v, list):
            return str(v)
        if v is None or v is pd.NA or v != v:
            return "~"
        return f"{v:.9g}" if isinstance(v, (int, float)) else str(v)

    return sorted(tuple(map(show, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
