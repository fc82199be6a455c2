"""Examples of each record operator, and the texts that must come out."""

import pytest
from pyspark.sql import functions as F

from siftlode.operators import dedupe, judge, names, probes, urls

FLAT = "idx long, name string, url string, grp string, type int, search_url string, explore_url string, login_url string, login_ui string, login_check_js string, js_lib string, enabled boolean, enabled_explore boolean, respond_time double, last_update_time long, weight double, rs_keys int, rs_list string, rs_name string, rs_author string, rs_url string, rs_check_key string, bi_keys int, bi_name string, bi_author string, toc_keys int, toc_list string, toc_name string, toc_url string, ct_keys int, ct_content string, ct_image string, ct_regex string"
FULL = dict(name="好书", url="https://www.example.com/a", grp="小说", type=0, search_url="/s?q={{key}}", rs_keys=3, rs_list=".l", rs_name="h3", rs_url="a@href", bi_keys=1, bi_name="h1", toc_keys=1, toc_list=".c", ct_keys=1, ct_content="#c")
COLUMNS = [c.split(" ")[0] for c in FLAT.split(", ")]


def frame(spark, *rows):
    return spark.createDataFrame([tuple({**dict.fromkeys(COLUMNS), "idx": i, **r}[c] for c in COLUMNS) for i, r in enumerate(rows)], FLAT)


@pytest.mark.parametrize("name,mode,latin,want", [
    ("🚖 橘子湾", "zh-only", False, "橘子湾"), ("❤️青石书屋@阿远", "loose", False, "青石书屋"), ("竹影看书（优++）", "loose", False, "竹影看书"), ("🎧 KQ有声", "zh-only", False, "有声"),
    ("🎧 KQ有声", "loose", False, "KQ有声"), ("🎧 KQ有声", "zh-only", True, "KQ有声"), ("测试站点 失效", "loose", False, "测试站点 失效"), ("青石#21", "loose", False, "青石"), ("", "loose", False, ""), (None, "loose", False, ""), ("导入站", "loose", False, "入站"),
])
def test_names(spark, name, mode, latin, want):
    df = spark.createDataFrame([(1, name)], "idx long, name string")
    row = names.clean_names(df, mode=mode, keep_latin=latin, url=F.lit("u"), index=F.col("idx")).first()
    assert row.clean.cleaned == want
    assert (row.clean.warnings == ["EMPTY_NAME"]) == (not name)
    assert all(s["from"] != s["to"] for s in row.clean.steps)


def test_name_fallbacks(spark):
    df = spark.createDataFrame([(7, "🚖🚖")], "idx long, name string")
    assert names.clean_names(df, url=F.lit("https://x.y"), index=F.col("idx")).first().clean.warnings == ["CLEAN_NAME_EMPTY_FALLBACK_URL"]
    assert names.clean_names(df, index=F.col("idx")).first().clean.cleaned == "未命名源-7"


@pytest.mark.parametrize("url,want", [
    ("http://www.example.com/", ("http://www.example.com", "example.com", "VALID_HTTP")), ("www.example.com", ("https://www.example.com", "example.com", "NON_HTTP_LOOKS_LIKE_DOMAIN")),
    ("not a url at all !!!", ("not a url at all", "not_a_url_at_all", "NON_HTTP_SOURCE")), ("  ", (None, None, "INVALID_URL")), (None, (None, None, "INVALID_URL")), ("https://m.www.a.com:80/x#t", ("https://m.www.a.com:80/x", "www.a.com", "VALID_HTTP")), ("全中文", ("全中文", "全中文", "NON_HTTP_SOURCE")),
])
def test_urls(spark, url, want):
    n = urls.with_url(spark.createDataFrame([(url,)], "url string")).first().norm
    assert (n.url, n.normalized_host, n.url_status) == want


def cls(spark, **r):
    df = frame(spark, {"name": "中性", **r}).withColumn("cleaned_name", F.col("name"))
    return judge.classify(df).first().cls


def test_classification(spark):
    assert cls(spark, type=0, ct_regex="m3u8").category == "影视"
    assert cls(spark, name="失效站点").category == "失效" == cls(spark, grp="失效").category
    assert (cls(spark, type=99).category, cls(spark, type=99).confidence) == ("其他", "low")
    assert (cls(spark, type=1, name="FM电台").category, cls(spark, type=1, name="FM电台").confidence) == ("有声", "high")
    assert (cls(spark, type=2, name="漫画站").category, cls(spark, type=2, name="漫画站").confidence) == ("漫画", "high")
    assert cls(spark, type=0, name="漫画").conflict == "type-vs-keyword:小说-vs-漫画"


def test_structure(spark):
    s = frame(spark, FULL, {}, {**FULL, "ct_content": None, "ct_image": "FULL"}).select(judge.structure()["status"].alias("s"), judge.structure(F.lit("小说"))["status"].alias("n"), judge.structure(F.lit("漫画"))["status"].alias("c")).collect()
    assert [tuple(r) for r in s] == [("STRUCTURE_OK",) * 3, ("STRUCTURE_INVALID",) * 3, ("STRUCTURE_OK", "STRUCTURE_INVALID", "STRUCTURE_OK")]


def test_score_parts(spark):
    as_of = 1_700_000_000_000
    df = frame(spark, {**FULL, "enabled": True, "weight": 10000.0, "last_update_time": as_of - 86_400_000, "respond_time": 100.0}, {"name": "失效", "respond_time": 40000.0, "last_update_time": as_of * 2})
    df = df.withColumns({"availability": F.when(F.col("idx") == 0, "usable").otherwise("dead"), "connectivity": F.lit("NOT_CHECKED"), "search_status": F.lit("NOT_CHECKED"), "confidence": F.lit("high"), "measured_respond_time": F.lit(None).cast("double")})
    good, bad = judge.score(df, as_of).orderBy("idx").collect()
    assert good.score == sum(good.score_breakdown.values()) and good.score_breakdown["availability_usable"] == 100 and good.score_breakdown["weight"] == 10 and good.score_breakdown["last_update"] == 20
    want = {"availability_dead": -100, "missing_search_url": -20, "missing_rule_search": -20, "name_contains_dead": -40, "respond_time_high": -20, "respond_time": 0}
    assert want.items() <= bad.score_breakdown.items() and "last_update" not in bad.score_breakdown and bad.risks == ["FUTURE_TIMESTAMP"]


def test_dedupe_prefers_score_and_vetoes_risk(spark):
    rows = [{**FULL, "url": "https://www.example.com/a"}, {**FULL, "url": "https://m.example.com/b"}, {**FULL, "url": "https://x.org"}, {**FULL, "url": "https://www.x.org/1", "type": 2}]
    df = frame(spark, *rows).withColumns({"cleaned_name": F.col("name"), "category": F.lit("小说"), "availability": F.lit("usable"), "score": F.when(F.col("idx") == 1, 90).otherwise(30)})
    host = {r.idx: (r.dup_kept, r.dup_risk) for r in dedupe.dedupe(df, "host").collect()}
    assert host == {0: (False, False), 1: (True, False), 2: (True, True), 3: (True, True)}
    assert not dedupe.dedupe(df, "host", allow_risky=True).where("dup_risk").count()
    assert dedupe.dedupe(df, "exact").where("not dup_kept").count() == 0
    m = dedupe.dedupe(df, "host")
    g = dedupe.listed(m, dedupe.groups(m, "host")).orderBy("group_id").collect()
    assert [(r.kept_idx, r.removed_indices) for r in g] == [(1, [0]), (2, [])]


def test_batch_status(spark):
    none = F.array().cast("array<string>")
    stages = F.array(F.struct(F.lit("search").alias("stage"), F.lit("PASS").alias("status")), F.struct(F.lit("toc").alias("stage"), F.lit("FAIL").alias("status")))
    st = lambda reasons, stages_=stages, **k: spark.range(1).select(probes.batch_status(F.lit(k.get("structure", "STRUCTURE_OK")), F.lit(k.get("search", "/s")), F.lit("https://a.b"), reasons, F.lit(k.get("login")), F.lit("usable"), stages_, F.array(F.lit("FUTURE_TIMESTAMP")) if k.get("risk") else none)).first()[0]
    assert st(none) == "PARTIAL_PASS" and st(F.array(F.lit("http_403"))) == "BLOCKED" and st(none, structure="STRUCTURE_INVALID") == "FAIL" and st(none, search=" ") == "FAIL"
    fast = F.array().cast("array<struct<stage:string,status:string>>")
    assert st(none, fast) == "PASS" and st(none, fast, risk=True) == "RISKY" and st(none, login="needsLogin") == "NEEDS_LOGIN"


def test_search_requests(spark):
    r = lambda t: spark.range(1).select(urls.search_request(F.lit(t), F.lit("https://example.com/x/"), F.lit("斗破 苍穹"), F.lit(5)).alias("r")).first().r
    assert r("/search?q={{key}}").url == "https://example.com/search?q=%E6%96%97%E7%A0%B4%20%E8%8B%8D%E7%A9%B9"
    post = r('/search,{"method":"POST","body":"searchkey={{key}}"}')
    assert (post.method, post.body) == ("POST", "searchkey=%E6%96%97%E7%A0%B4%20%E8%8B%8D%E7%A9%B9")
    assert r("/p/<1,2,3>").url == "https://example.com/p/3" and r('/s,{"method":"post"}').body.startswith("searchkey=%E6")
