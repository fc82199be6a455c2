"""Queries of the record operators: names, urls, classification, structure, score, dedupe, groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlode.functions.text import csv_audit_field, csv_field, encode_component
from siftlode.operators import audit, dedupe, judge, names, urls
from siftlode.plans import oracles as O
from siftlode.plans.testdata import catalog, judged, table
from siftlode.sources import schema

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


@query(f"""with {O.urls_cte('pages', 'page_id, url')}, r as (select page_id, url, url_status, host_key, row_number() over (partition by host_key order by length(url) desc, page_id) as rn from nu where host_key is not null)
select host_key, page_id, url, url_status from r where rn = 1""")
def host_survivor(spark, sf_dir):
    """Flagship: of each site the page with the longest url, the first of equals."""
    from pyspark.sql import Window

    norm = urls.with_url(table(spark, sf_dir, "pages").select("page_id", "url"), into="n").select("page_id", "url", "n.url_status", F.col("n.normalized_host").alias("host_key"))
    order = Window.partitionBy("host_key").orderBy(F.length("url").desc(), "page_id")
    best = norm.withColumn("rn", F.row_number().over(order)).where("rn = 1")
    return best.where("url_status <> 'INVALID_URL'").select("host_key", "page_id", "url", "url_status")


def _clean(mode):
    def run(spark, sf_dir):
        df = names.clean_names(catalog(spark, sf_dir), mode=mode, url=F.col("url"), index=F.col("idx"))
        return df.select("idx", "name", F.col("clean.cleaned").alias("cleaned"), F.array_join("clean.warnings", ",").alias("warning"))

    return run


for _mode in ("loose", "zh-only"):
    query(f"with {O.names_cte(_mode)} select idx, name, cleaned_name as cleaned, coalesce(warning, '') as warning from nm", f"clean_names_{_mode.replace('-', '_')}")(_clean(_mode))


@query(O.name_steps_sql())
def clean_name_steps(spark, sf_dir):
    df = names.clean_names(catalog(spark, sf_dir), url=F.col("url"), index=F.col("idx")).select("idx", F.explode("clean.steps").alias("s"))
    number = F.create_map(*[x for i, (r, _) in enumerate(names.STEPS, 1) for x in (F.lit(r), F.lit(i))])
    return df.select("idx", number[F.col("s.reason")].alias("step"), "s.reason", F.col("s.from").alias("before"), F.col("s.to").alias("after"))


@query(f"with cat as ({O.CATALOG_SQL}), {O.urls_cte('cat', 'idx, url')} select idx, url, candidate, url_status, norm_url, host, host_key, case when candidate is not null then url_key end as url_key from nu")
def url_normalize(spark, sf_dir):
    df = urls.with_url(catalog(spark, sf_dir).select("idx", "url"), into="n").withColumn("url_key", urls.url_key(F.col("url"), F.col("n.candidate")))
    return df.select("idx", "url", "n.candidate", "n.url_status", F.col("n.url").alias("norm_url"), "n.host", F.col("n.normalized_host").alias("host_key"), "url_key")


URL_CASES = ("http://www.example.com/", "HTTPS://M.Example.com:8080/a/?q#f", "www.example.com", "not a url at all !!!", "小说网", "https://a.com,备用", "a.b.cc/x/", "  ", "https://", "ftp://x.y", "https://u:p@h5.site.org/p", "wap.m.site.net")
_cases = ", ".join(f"({i}, '{u}')" for i, u in enumerate(URL_CASES))


@query(f"with cases(i, url) as (values {_cases}), {O.urls_cte('cases')} select i, url, candidate, url_status, norm_url, host, host_key, url_key, is_http, is_domain from nu")
def url_cases(spark, sf_dir):
    df = spark.sql(f"select * from values {_cases} as t(i, url)").withColumn("n", urls.normalize_url(F.col("url")))
    c = F.col("n.candidate")
    return df.select("i", "url", c.alias("candidate"), "n.url_status", F.col("n.url").alias("norm_url"), "n.host", F.col("n.normalized_host").alias("host_key"), urls.url_key(F.col("url")).alias("url_key"), urls.is_http(c).alias("is_http"), urls.looks_like_domain(c).alias("is_domain"))


@query("select conv_id, turn, replace(replace(replace(replace(replace(url_encode(text), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*') as coded from conversations")
def encode_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", encode_component(F.col("text")).alias("coded"))


@query(f"with {O.names_cte()}, {O.class_cte()} select idx, category, confidence, conflict, tc as from_type, gc as from_group from cl")
def classify_catalog(spark, sf_dir):
    df = names.clean_names(catalog(spark, sf_dir), url=F.col("url"), index=F.col("idx")).withColumn("cleaned_name", F.col("clean.cleaned"))
    return judge.classify(df).select("idx", "cls.category", "cls.confidence", "cls.conflict", "cls.from_type", "cls.from_group")


@query(f"with {O.names_cte()}, {O.class_cte()}, {O.struct_cte()} select idx, structure_status, reasons from st")
def structure_reasons(spark, sf_dir):
    df = names.clean_names(catalog(spark, sf_dir), url=F.col("url"), index=F.col("idx")).withColumn("cleaned_name", F.col("clean.cleaned"))
    df = judge.classify(df).withColumn("s", judge.structure(F.col("cls.category")))
    return df.select("idx", F.col("s.status").alias("structure_status"), F.array_join("s.reasons", "; ").alias("reasons"))


@query(f"with cat as ({O.CATALOG_SQL}), {O.struct_cte('cat', 'cast(null as varchar)')} select structure_status, count(*) as n from st group by 1")
def structure_plain_counts(spark, sf_dir):
    """The validate command's form, which knows no category."""
    return catalog(spark, sf_dir).select(judge.structure()["status"].alias("structure_status")).groupBy("structure_status").agg(F.count("*").alias("n"))


@query(f"with cat as ({O.CATALOG_SQL}) select idx, {O.LOGIN} as login from cat")
def login_catalog(spark, sf_dir):
    return catalog(spark, sf_dir).select("idx", judge.login_status().alias("login"))


_st = ("STRUCTURE_OK", "STRUCTURE_WARN", "STRUCTURE_INVALID")
_lo = ("needsLogin", "loginRelated", "none")
_co = ("NOT_CHECKED", "NON_HTTP_SOURCE", "CONNECT_OK", "CONNECT_FORBIDDEN", "CONNECT_DEAD", "CONNECT_TIMEOUT", "CONNECT_ERROR")
_se = ("NOT_CHECKED", "SEARCH_HTTP_OK", "SEARCH_PARSE_OK", "SEARCH_RULE_LIKELY_OK", "SEARCH_TEMPLATE_COMPLEX", "SEARCH_COMPLEX_JS_SKIPPED", "SEARCH_SKIPPED_JS", "SEARCH_UNVERIFIED", "SEARCH_FAILED")
_states = [(a, b, c, d, u) for a in _st for b in _lo for c in _co for d in _se for u in ("https://a.b/s", "/s")]
_values = ", ".join("('" + "', '".join(s) + "')" for s in _states)


@query(f"with v(structure_status, login, connectivity, search_status, search_url) as (values {_values}) select *, {O.AVAILABILITY} as availability from v")
def availability_cases(spark, sf_dir):
    df = spark.sql(f"select * from values {_values} as t(structure_status, login, connectivity, search_status, search_url)")
    return df.withColumn("availability", judge.availability(*[F.col(c) for c in ("structure_status", "login", "connectivity", "search_status", "search_url")]))


@query(f"{O.upto_score()} select idx, availability, score from sc")
def score_total(spark, sf_dir):
    return judged(spark, sf_dir).select("idx", "availability", "score")


@query(f"{O.upto_score()} " + " union all ".join(f"select idx, '{k}' as component, cast({v} as int) as points from sc where {c}" for k, c, v in O.score_parts()))
def score_breakdown(spark, sf_dir):
    return judged(spark, sf_dir).select("idx", F.explode("score_breakdown").alias("component", "points"))


def _dedupe(level):
    def run(spark, sf_dir):
        m = dedupe.ranked(dedupe.dedupe(judged(spark, sf_dir), level))
        return m.select("idx", "dedupe_key", "dup_rank", "dup_size", "dup_risk", "dup_kept", F.col("k.idx").alias("kept_idx"), dedupe.removed_reason().alias("removed_reason"))

    return run


for _level in dedupe.LEVELS[1:]:
    query(f"{O.upto_dedupe(_level)} select idx, dedupe_key, cast(dup_rank as int) as dup_rank, dup_size, dup_risk, dup_kept, kidx as kept_idx, {O.reason()} as removed_reason from de", f"dedupe_{_level}")(_dedupe(_level))


@query(f"{O.upto_dedupe('host')} select dedupe_key, idx, score from de where dup_rank = 1 and dedupe_key is not null")
def dedupe_survivors(spark, sf_dir):
    return dedupe.survivors(judged(spark, sf_dir), "host").where(~F.col("dedupe_key").startswith("\x00")).select("dedupe_key", "idx", "score")


def _groups(level):
    def run(spark, sf_dir):
        m = dedupe.dedupe(judged(spark, sf_dir), level)
        g, gone = dedupe.groups(m, level), dedupe.removed(m)
        g = g.join(gone, F.col("dedupe_key") == F.col("__key"), "left")
        return g.select(F.col("group_id").cast("long").alias("group_id"), "group_key", "kept_idx", "kept_name", "dup_risk", "reason", F.coalesce("removed", F.lit("")).alias("removed"))

    return run


for _level in ("host", "url"):
    from siftlode.functions.vocab import DEDUPE_REASON

    query(f"""{O.upto_dedupe(_level)}, g as (select dedupe_key, dup_first_idx, dup_risk, max(kidx) as kept_idx, max(kname) as kept_name, string_agg(case when dup_rank > 1 and not dup_risk then cast(idx as varchar) end, ',' order by dup_rank) as removed from de where dup_size > 1 and dedupe_key is not null group by all)
select cast(row_number() over (order by dup_first_idx) - 1 as bigint) as group_id, dedupe_key || case when dup_risk then ' (RISK: type/category conflict — NOT auto-removed)' else '' end as group_key, kept_idx, kept_name, dup_risk,
case when dup_risk then 'dedupe-risk: host matched but type/category differs — kept all' else '{DEDUPE_REASON[_level]}' end as reason, coalesce(removed, '') as removed from g""", f"dedupe_groups_{_level}")(_groups(_level))


@query(f"""{O.upto_dedupe('host')} select dedupe_key, kidx as kept_idx, idx as removed_idx, kscore - score as score_diff, type is distinct from ktype as type_conflict, category is distinct from kcat as category_conflict,
concat_ws('; ', case when rs_list is distinct from krs_list then 'ruleSearch.bookList' end, case when rs_name is distinct from krs_name then 'ruleSearch.name' end, case when rs_url is distinct from krs_url then 'ruleSearch.bookUrl' end, case when bi_name is distinct from kbi_name then 'ruleBookInfo.name' end, case when toc_list is distinct from ktoc_list then 'ruleToc.chapterList' end, case when ct_content is distinct from kct_content then 'ruleContent.content' end) as rule_differences,
case when coalesce(last_update_time, 0) > coalesce(klast, 0) then 'removed is newer (' || coalesce(last_update_time, 0) || ' > ' || coalesce(klast, 0) || ')' when coalesce(last_update_time, 0) < coalesce(klast, 0) then 'kept is newer' else 'same freshness' end as freshness,
case when coalesce(respond_time, 'inf'::double) < coalesce(krt, 'inf'::double) then 'removed responds faster (' || cast(respond_time as bigint) || 'ms < ' || coalesce(cast(cast(krt as bigint) as varchar), 'Infinity') || 'ms)' when coalesce(respond_time, 'inf'::double) > coalesce(krt, 'inf'::double) then 'kept responds faster' else 'same respondTime' end as respond_speed,
'score: ' || kscore || ', availability: ' || kavail as why_kept from de where dup_size > 1 and dup_rank > 1 and dedupe_key is not null""")
def dedupe_field_diff(spark, sf_dir):
    d = dedupe.field_diff(dedupe.dedupe(judged(spark, sf_dir), "host"))
    return d.select("dedupe_key", "kept_idx", "removed_idx", "score_diff", "type_conflict", "category_conflict", "rule_differences", "freshness", "respond_speed", "why_kept")


@query("select md5(lower(trim(text))) as text_key, count(*) as n, min(doc_id) as first_doc from documents group by 1 having count(*) > 1")
def duplicate_documents(spark, sf_dir):
    found = audit.repeated(table(spark, sf_dir, "documents"), F.md5(F.lower(F.trim("text"))), "doc_id")
    return found.select(F.col("key").alias("text_key"), "n", F.col("first").alias("first_doc"))


def _group_mode(mode):
    def run(spark, sf_dir):
        df = names.clean_names(catalog(spark, sf_dir), url=F.col("url"), index=F.col("idx")).withColumn("cleaned_name", F.col("clean.cleaned"))
        return judge.classify(df).withColumn("g", judge.final_group(mode, F.col("cls.category"), F.col("grp"))).select("idx", "g.final_group", "g.reason")

    return run


for _mode, _sql in {
    "overwrite": ("category", "'overwrite'"), "append": ("case when coalesce(grp, '') = '' then category when contains(grp, category) then grp else grp || ', ' || category end", "'append'"),
    "preserve": ("coalesce(grp, '')", "'preserved-original'"), "report-only": ("coalesce(grp, '')", "'report-only (suggested: ' || category || ')'"),
    "category-first": (O.CATEGORY_FIRST, "'category-first'"),
}.items():
    query(f"with {O.names_cte()}, {O.class_cte()} select idx, {_sql[0]} as final_group, {_sql[1]} as reason from cl", "group_mode_" + _mode.replace("-", "_"))(_group_mode(_mode))


@query("select doc_id, case when regexp_matches(f, '[,\"\\n]') then '\"' || replace(f, '\"', '\"\"') || '\"' else f end as field, case when regexp_matches(c, '[,\"]') then '\"' || replace(c, '\"', '\"\"') || '\"' else c end as audit_field from (select doc_id, c, case when regexp_matches(c, '^[=+\\-@\\t\\r]') then '''' || c else c end as f from (select doc_id, case doc_id % 4 when 0 then '=' || text when 1 then '@' || source else coalesce(text, '') end as c from documents))")
def csv_escape(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("c", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("="), "text")).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("@"), "source")).otherwise(F.coalesce("text", F.lit(""))))
    return d.select("doc_id", csv_field(F.col("c")).alias("field"), csv_audit_field(F.col("c")).alias("audit_field"))


#: Records with fields of wrong types by the page's number, as JSON text that Spark and DuckDB both make.
_RECORDS = """select page_id as idx, '{"bookSourceName":' || case page_id % 5 when 0 then '7' when 1 then 'null' else '"n' || cast(page_id as string) || '"' end
  || ',"bookSourceType":' || case page_id % 7 when 0 then '1.5' when 1 then 'null' when 2 then '"0"' else '0' end
  || ',"respondTime":' || case page_id % 4 when 0 then '"12"' when 1 then '12.5' when 2 then 'true' else '12' end
  || ',"enabled":' || case page_id % 6 when 0 then '1' else 'false' end
  || ',"ruleSearch":' || case page_id % 9 when 0 then '[1,"a",{"x":null}]' when 1 then 'null' when 2 then '{}' when 3 then '{"name":{"a":[[2],[]]},"own":1}' else '{"name":"h3","bookUrl":' || case when page_id % 2 = 0 then 'null' else '"a"' end || '}' end
  || ',"tags":[' || cast(length(url) as string) || ',"' || cast(page_id % 3 as string) || '"]}' as json from {pages}"""
_TREE = f"""t as (select idx, regexp_replace(fullkey, '\\[[0-9]+\\]', '[*]', 'g') as path, case when type = 'VARCHAR' then 'string' when type in ('UBIGINT', 'BIGINT') then 'integer' when type = 'DOUBLE' then 'number' else lower(type) end as kind
  from ({_RECORDS.replace('{pages}', 'pages')}) r, json_tree(r.json::json))"""


def _records(spark, sf_dir):
    text = _RECORDS.replace("{pages}", "pages_in").replace("{", "{{").replace("}", "}}").replace("pages_in", "{pages}")
    return spark.sql(text, pages=table(spark, sf_dir, "pages")).select("idx", F.parse_json("json").alias("record"))


@query(f"with {_TREE} select path, kind, count(*) as n, min(idx) as first_idx from t group by all")
def schema_drift(spark, sf_dir):
    return schema.drift(_records(spark, sf_dir))


@query(f"""with {_TREE}, d as (select unnest([{", ".join(f"{{'p': '{p}', 'want': '{w}'}}" for p, w in schema.DECLARED.items())}], recursive := true))
select idx, path, rtrim(want, '?') as expected, kind as found from t join d on path = p
where kind <> rtrim(want, '?') and not (kind = 'integer' and want = 'number?') and not (kind = 'null' and want like '%?')""")
def schema_issues(spark, sf_dir):
    return schema.issues(_records(spark, sf_dir))


@query("select regexp_replace(fullkey, '\\[[0-9]+\\]', '[*]', 'g') as path, case when type = 'VARCHAR' then 'string' when type in ('UBIGINT', 'BIGINT') then 'integer' when type = 'DOUBLE' then 'number' else lower(type) end as kind, count(*) as n, min(event_id) as first_idx from events, json_tree(props::json) group by all")
def props_drift(spark, sf_dir):
    """Fields of the events' properties by type."""
    return schema.drift(table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("record")), "event_id")
