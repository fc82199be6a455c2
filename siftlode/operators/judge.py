"""Classification, structure, login, availability and score of catalog records, as expressions.

All take the flat catalog columns of siftlode.sources.catalog and add columns; none needs a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlode.functions import vocab
from siftlode.functions.plan import barrier
from siftlode.functions.text import ascii_bounded, blank, filled, matches, words_re

KEYWORD_ORDER = ("漫画", "小说", "有声", "影视", "下载")
ENGLISH = {"小说": "novel", "漫画": "comic", "有声": "audio", "影视": "video", "下载": "download"}
DAY_MS = 86_400_000


def has_keyword(c: Column, category: str) -> Column:
    return matches(F.lower(c), words_re(vocab.KEYWORDS[category]))


def type_category(kind: Column) -> Column:
    return F.when(kind == 0, "小说").when(kind == 1, "有声").when(kind == 2, "漫画").when(kind == 3, "下载")


def first_keyword_category(c: Column) -> Column:
    out = F.lit(None).cast("string")
    for category in reversed(KEYWORD_ORDER):
        out = F.when(has_keyword(c, category), category).otherwise(out)
    return out


def classify(df: DataFrame, name: str = "cleaned_name", into: str = "cls") -> DataFrame:
    """+ struct into: category, confidence, tags, from_type, from_name, from_group, from_rules, conflict.

    Votes are an array of (weight, order of appearance, category); a category's total is the sum of its
    votes, its rank their least order, and the winner the greatest total, the earliest rank.
    """
    shown = F.coalesce(F.when(filled(F.col(name)), F.col(name)), F.col("name"), F.lit(""))
    group = F.coalesce("grp", F.lit(""))
    text = F.concat_ws(" ", shown, group)
    media = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("ct_regex", "search_url", "explore_url")]))
    prefix = f"__{into}_"
    hits = {f"{prefix}k{i}": has_keyword(text, c) for i, c in enumerate(KEYWORD_ORDER)}
    hits |= {f"{prefix}m{i}": matches(media, m[3]) for i, m in enumerate(vocab.MEDIA_MARKS)}
    hits |= {f"{prefix}type": type_category(F.col("type")), f"{prefix}group": first_keyword_category(group)}
    hits |= {f"{prefix}n{i}": has_keyword(shown, c) for i, c in enumerate(KEYWORD_ORDER)}
    df = df.withColumns(hits)

    def vote(cond, weight, rank, category):
        return F.when(cond, F.struct(F.lit(weight).alias("w"), F.lit(rank).alias("r"), (category if isinstance(category, Column) else F.lit(category)).alias("c")))

    at, V = (lambda x: F.col(f"{prefix}{x}")), vocab.VOTES
    votes = [vote(at("type").isNotNull(), V["type"], 0, at("type")), vote(at("type").isNull(), V["no_type"], 0, "其他")]
    votes += [vote(at(f"k{i}"), V["keyword"], 1 + i, c) for i, c in enumerate(KEYWORD_ORDER)]
    votes += [vote(at(f"m{i}"), m[1], 6 + i, m[0]) for i, m in enumerate(vocab.MEDIA_MARKS)]
    votes += [vote(at("group").isNotNull(), V["group"], 10, at("group"))]
    votes += [vote((F.col("type") == 1) & at("n2"), V["type_and_keyword"], 11, "有声"), vote((F.col("type") == 2) & at("n0"), V["type_and_keyword"], 11, "漫画")]
    df = df.withColumn(f"{prefix}votes", F.array_compact(F.array(*votes)))
    total = lambda c: F.aggregate(F.filter(at("votes"), lambda v: v["c"] == c), F.lit(0), lambda a, v: a + v["w"])
    rank = lambda c: F.array_min(F.transform(F.filter(at("votes"), lambda v: v["c"] == c), lambda v: v["r"]))
    totals = F.transform(F.array_distinct(F.transform(at("votes"), lambda v: v["c"])), lambda c: F.struct(total(c).alias("s"), (-rank(c)).alias("o"), c.alias("c")))
    df = df.withColumn(f"{prefix}sums", F.sort_array(totals, asc=False))
    best, second = F.element_at(at("sums"), 1), F.coalesce(F.get(at("sums"), F.lit(1))["s"], F.lit(0))
    top_keyword = F.lit(None).cast("string")
    for i, c in reversed(list(enumerate(KEYWORD_ORDER))):
        top_keyword = F.when(at(f"k{i}"), c).otherwise(top_keyword)
    conflict = F.when(at("type").isNotNull() & top_keyword.isNotNull() & (at("type") != top_keyword), F.concat(F.lit("type-vs-keyword:"), at("type"), F.lit("-vs-"), top_keyword))
    df = df.withColumns({f"{prefix}conflict": conflict, f"{prefix}best": best, f"{prefix}second": second})
    s, clash = at("best")["s"], at("conflict").isNotNull()
    confidence = (
        F.when(s >= 20, F.when((at("second") > 0) & (s - at("second") <= 10) & clash, "conflict").when(clash, "medium").otherwise("high"))
        .when(s >= 10, F.when(clash, "low").otherwise("medium")).otherwise("low")
    )
    dead = matches(F.concat_ws(" ", F.coalesce("name", F.lit("")), group), vocab.DEAD_MARKS)
    tags = [F.when(at(f"m{i}"), F.lit(f"{m[2]}-rule-detected")) for i, m in enumerate(vocab.MEDIA_MARKS)] + [F.when(dead, F.lit("marked-dead"))]
    names = [F.when(at(f"n{KEYWORD_ORDER.index(c)}"), F.lit(e)) for c, e in ENGLISH.items()]
    rules = [F.when(at(f"m{i}"), F.lit(ENGLISH[m[0]])) for i, m in enumerate(vocab.MEDIA_MARKS)]
    out = F.struct(
        F.when(dead, "失效").otherwise(at("best")["c"]).alias("category"), F.when(dead, "high").otherwise(confidence).alias("confidence"),
        F.array_compact(F.array(*tags)).alias("tags"), at("type").alias("from_type"), F.array_compact(F.array(*names)).alias("from_name"),
        at("group").alias("from_group"), F.array_compact(F.array(*rules)).alias("from_rules"), at("conflict").alias("conflict"),
    )
    return barrier(df.withColumn(into, out)).drop(*[c for c in df.columns if c.startswith(prefix)])


def structure(category: Column | None = None) -> Column:
    """struct(status, reasons): what a record lacks, the critical and the lesser, in fixed order."""
    cat = F.lit(None).cast("string") if category is None else category
    absent = lambda keys: F.coalesce(F.col(keys), F.lit(0)) == 0
    novel = F.coalesce(cat == "小说", F.lit(False))
    no_content, no_image = blank(F.col("ct_content")), blank(F.col("ct_image"))
    has_rule = ~absent("ct_keys")
    content_reason = F.when(cat == "漫画", "Missing ruleContent.content (novel) or imageStyle (comic)").when(cat == "下载", "Missing ruleContent.content (download link)").otherwise("Missing ruleContent.content")
    strict = F.coalesce(cat.isin("小说", "有声", "下载"), F.lit(False))
    rules = [
        (blank(F.col("name")), "Missing bookSourceName", True),
        (blank(F.col("url")), "Missing bookSourceUrl", True),
        (F.col("type").isNull(), "Missing bookSourceType", False),
        (blank(F.col("search_url")), "Missing searchUrl", False),
        (absent("rs_keys"), "Missing ruleSearch", True),
        (~absent("rs_keys") & blank(F.col("rs_list")), "Missing ruleSearch.bookList", False),
        (~absent("rs_keys") & blank(F.col("rs_name")), "Missing ruleSearch.name", False),
        (~absent("rs_keys") & blank(F.col("rs_url")), "Missing ruleSearch.bookUrl", False),
        (absent("bi_keys"), "Missing ruleBookInfo", False),
        (~absent("bi_keys") & blank(F.col("bi_name")), "Missing ruleBookInfo.name", False),
        (absent("toc_keys"), "Missing ruleToc", False),
        (~absent("toc_keys") & blank(F.col("toc_list")), "Missing ruleToc.chapterList", False),
        (~has_rule, "Missing ruleContent", novel),
        (has_rule & no_content & (strict | no_image), content_reason, novel),
    ]
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    reasons = F.array_compact(F.array(*[F.when(c, as_col(r)) for c, r, _ in rules]))
    critical = F.array_contains(F.array(*[c & as_col(k) for c, _, k in rules]), True)
    return F.struct(F.when(critical, "STRUCTURE_INVALID").when(F.size(reasons) > 0, "STRUCTURE_WARN").otherwise("STRUCTURE_OK").alias("status"), reasons.alias("reasons"))


def login_status() -> Column:
    any_ = filled(F.col("login_url")) | filled(F.col("login_ui")) | filled(F.col("login_check_js"))
    return F.when(any_, F.when(matches(F.col("login_check_js"), "(?i)cookie|token|session"), "needsLogin").otherwise("loginRelated"))


def availability(structure_status: Column, login: Column, connectivity: Column, search: Column, search_url: Column) -> Column:
    found = search.isin("SEARCH_HTTP_OK", "SEARCH_RULE_LIKELY_OK")
    return (
        F.when(structure_status == "STRUCTURE_INVALID", "invalid")
        .when(login == "needsLogin", "needs_login").when(login == "loginRelated", "login_related")
        .when(connectivity == "NOT_CHECKED", F.when(structure_status == "STRUCTURE_WARN", "probably_usable").otherwise("unknown"))
        .when(connectivity == "NON_HTTP_SOURCE", F.when(matches(search_url, "(?i)^https?://"), "probably_usable").otherwise("complex_unverified"))
        .when(connectivity == "CONNECT_OK", F.when(found | (search == "SEARCH_PARSE_OK"), "usable").when(search.isin("SEARCH_COMPLEX_JS_SKIPPED", "SEARCH_SKIPPED_JS", "SEARCH_TEMPLATE_COMPLEX"), "complex_unverified").otherwise("probably_usable"))
        .when(connectivity == "CONNECT_FORBIDDEN", "forbidden")
        .when(connectivity == "CONNECT_DEAD", F.when(found, "probably_usable").otherwise("dead"))
        .when(connectivity == "CONNECT_TIMEOUT", "timeout")
        .otherwise("unknown")
    )


def _bracket(value: Column, brackets: tuple) -> Column:
    out = F.lit(0)
    for most, bonus in reversed(brackets):
        out = F.when(value <= most, bonus).otherwise(out)
    return out


def js_tier(fields: list[Column]) -> Column:
    """eval, dynamic, static, or null: the hardest script mark in any field."""
    text = F.concat_ws("\n", *fields)
    any_of = lambda patterns: "(?i)" + "|".join(ascii_bounded(p) for p in patterns)
    return (
        F.when(text.rlike(any_of([r"\beval\b"])), "eval")
        .when(text.rlike(any_of([r"java\.ajax", r"\bcookie\b", r"\bcache\b", "WebView", "Reload", r"source\.getKey", r"source\.login"])), "dynamic")
        .when(text.rlike(any_of(vocab.COMPLEX_JS)), "static")
    )


def is_old(ts: Column, as_of: int) -> Column:
    return F.coalesce((ts <= 0) | (F.lit(as_of) - ts > 365 * DAY_MS), F.lit(True))


def score(df: DataFrame, as_of: int, into: str = "score") -> DataFrame:
    """+ into (int) and into_breakdown (map of every component that applies, zero ones included).

    Needs availability, connectivity, search_status, confidence, measured_respond_time.
    """
    rt = F.coalesce("measured_respond_time", "respond_time")
    ts, now = F.col("last_update_time"), F.lit(as_of)
    tier = js_tier([F.col(c) for c in ("search_url", "explore_url", "login_url", "login_check_js", "js_lib")])
    parts: list[tuple] = [("availability_" + k, F.col("availability") == k, v) for k, v in vocab.AVAILABILITY_SCORE.items()]
    parts += [
        ("connect_ok", F.col("connectivity") == "CONNECT_OK"),
        ("search_http_ok", F.col("search_status").isin("SEARCH_HTTP_OK", "SEARCH_PARSE_OK")),
        ("search_rule_likely_ok", F.col("search_status") == "SEARCH_RULE_LIKELY_OK"),
        ("enabled", F.col("enabled")), ("enabled_explore", F.col("enabled_explore")),
        ("has_search_url", filled(F.col("search_url"))), ("has_rule_search_booklist", filled(F.col("rs_list"))),
        ("has_rule_search_name", filled(F.col("rs_name"))), ("has_rule_search_bookurl", filled(F.col("rs_url"))),
        ("has_rule_bookinfo_name", filled(F.col("bi_name"))), ("has_rule_toc_chapterlist", filled(F.col("toc_list"))),
        ("has_rule_content_content", filled(F.col("ct_content"))),
        ("respond_time", rt >= 0, _bracket(rt, vocab.RESPOND_BONUS)), ("respond_time_high", rt > 30000),
        ("last_update", (ts > 0) & (ts <= now + DAY_MS), _bracket((now - ts) / DAY_MS, vocab.UPDATE_BONUS)),
        ("last_update_old", is_old(ts, as_of)),
        ("weight", F.col("weight").isNotNull(), F.coalesce(*[F.when(F.col("weight") >= least, bonus) for least, bonus in vocab.WEIGHT_BONUS], F.lit(0))),
        ("classification_high", F.col("confidence") == "high"),
    ]
    parts += [("availability_" + k, F.col("availability") == k, -v) for k, v in vocab.AVAILABILITY_PENALTY.items()]
    parts += [
        ("name_contains_dead", matches(F.col("name"), "失效")), ("group_contains_dead", matches(F.col("grp"), "失效|校验超时")),
        ("missing_search_url", ~filled(F.col("search_url"))), ("missing_rule_search", F.col("rs_keys").isNull()),
        ("missing_rule_content", F.coalesce(F.col("ct_keys"), F.lit(0)) == 0),
        ("needs_login", F.col("availability").isin("needs_login", "login_related")),
        ("complex_js_eval", tier == "eval"), ("complex_js_dynamic", tier == "dynamic"), ("complex_js_static", tier == "static"),
    ]
    entries = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(key).alias("key"), (v[0] if v and isinstance(v[0], Column) else F.lit(v[0] if v else vocab.POINTS[key])).cast("int").alias("value"))) for key, cond, *v in parts]))
    df = df.withColumn(f"{into}_entries", entries)
    total = F.aggregate(F.col(f"{into}_entries"), F.lit(0), lambda a, e: a + e["value"])
    risks = F.array_compact(F.array(F.when(ts > now + DAY_MS, F.lit("FUTURE_TIMESTAMP"))))
    return barrier(df.withColumns({into: total, f"{into}_breakdown": F.map_from_entries(f"{into}_entries"), "risks": risks})).drop(f"{into}_entries")


def rule_fields() -> Column:
    """How many of nine rule fields are filled."""
    return sum((filled(F.col(c)).cast("int") for c in ("rs_list", "rs_name", "rs_author", "rs_url", "bi_name", "bi_author", "toc_list", "toc_name", "ct_content")), F.lit(0))


def final_group(mode: str, category: Column, group: Column) -> Column:
    """struct(final_group, reason) of a group mode."""
    orig = F.coalesce(group, F.lit(""))
    kept = F.filter(F.transform(F.split(orig, ","), lambda t: F.trim(t)), lambda t: (t != "") & (t != category) & ~t.isin("小说", "漫画", "有声", "影视", "下载"))
    how = {
        "overwrite": (category, F.lit("overwrite")),
        "append": (F.when(orig == "", category).when(F.contains(orig, category), orig).otherwise(F.concat_ws(", ", orig, category)), F.lit("append")),
        "preserve": (orig, F.lit("preserved-original")),
        "report-only": (orig, F.concat(F.lit("report-only (suggested: "), category, F.lit(")"))),
        "category-first": (F.concat_ws(", ", category, F.when(F.size(kept) > 0, F.array_join(kept, ", "))), F.lit("category-first")),
    }
    value, reason = how.get(mode, how["overwrite"])
    return F.struct(value.alias("final_group"), reason.alias("reason"))


def file_key(category: Column) -> Column:
    out = F.lit("other")
    for c, k in vocab.FILE_KEYS.items():
        out = F.when(category == c, k).otherwise(out)
    return out


def search_word(check_key: Column, category: Column) -> Column:
    out = F.lit(vocab.SEARCH_WORDS["其他"])
    for c, k in vocab.SEARCH_WORDS.items():
        out = F.when(category == c, k).otherwise(out)
    return F.coalesce(F.nullif(F.trim(check_key), F.lit("")), out)


def excluded(status: Column, unavailable: bool = False, unknown: bool = False, complex_: bool = False) -> Column:
    gone = ([] if unavailable else ["dead", "timeout", "forbidden", "invalid"]) + ([] if unknown else ["unknown"]) + ([] if complex_ else ["complex_unverified"])
    return status.isin(*gone) if gone else F.lit(False)
