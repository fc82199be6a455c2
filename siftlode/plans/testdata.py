"""The driver's tables seen as a catalog: one text that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlode.functions.plan import barrier, spread
from siftlode.operators import judge, names, urls

AS_OF = 1_767_225_600_000

CATALOG_SQL = """
with t as (select page_id, url, html, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) as title from pages)
select page_id as idx,
  case page_id % 11 when 0 then '🚖 ' || title when 1 then title || '（优++）' when 2 then title || '@遇知' when 3 then title || '小说#21'
    when 4 then '【推荐】' || title || '漫画' when 5 then title || ' 有声(连载中)' when 6 then '✨失效站✨' when 7 then ''
    when 8 then '笔趣阁优++' || ' by ' || title when 9 then '❤️测试 导入 #备注' else '『电台』 ' || title end as name,
  case when page_id % 17 = 0 then 'Custom ID ' || cast(page_id % 5 as string) when page_id % 19 = 0 then null when page_id % 23 = 0 then 'novel.example.com/x/' when page_id % 13 = 0 then url || '备用' else url end as url,
  case page_id % 6 when 0 then '小说' when 1 then '漫画, 精选' when 2 then '有声,小说,校验超时' when 3 then null when 4 then '精选, 小说站' else '失效' end as grp,
  case when page_id % 5 = 4 then null else cast(page_id % 5 as int) end as type,
  case page_id % 8 when 0 then null when 1 then '/search?q={{key}}&p={{page}}' when 2 then 'https://www.example.com/s/{{keyword}}.mp3' when 3 then '/find,{"method":"POST","body":"searchkey={{key}}"}'
    when 4 then '@js:java.ajax(url)' when 5 then 'search/<1,2,3>/{{key}}.jpg' when 6 then '/s?k={{key}}&c=中cookie' else '/vod/{{source.bookSourceUrl}}' end as search_url,
  case page_id % 10 when 3 then '/explore/m3u8' when 5 then 'eval(x)' else null end as explore_url,
  case page_id % 14 when 2 then 'https://example.com/login' else null end as login_url, cast(null as string) as login_ui,
  case page_id % 15 when 4 then 'check(Cookie)' when 5 then 'check()' else null end as login_check_js, cast(null as string) as js_lib,
  page_id % 3 <> 0 as enabled, page_id % 4 = 1 as enabled_explore,
  cast(case when page_id % 9 = 0 then -1 when page_id % 21 = 0 then null else (page_id * 137) % 40000 end as double) as respond_time,
  case when page_id % 12 = 0 then null when page_id % 31 = 0 then cast(1775000000000 as bigint) else 1767225600000 - (page_id * 7919 % 500) * 86400000 end as last_update_time,
  cast(case when page_id % 10 = 9 then null else (page_id * 53) % 12000 end as double) as weight,
  case when page_id % 16 = 1 then null when page_id % 16 = 2 then 0 else 4 end as rs_keys,
  case when page_id % 16 in (1, 2) or page_id % 7 = 3 then null else '.list .book' end as rs_list, case when page_id % 16 in (1, 2) then null else 'h3@text' end as rs_name,
  case when page_id % 16 in (1, 2) or page_id % 3 = 0 then null else '.author' end as rs_author, case when page_id % 16 in (1, 2) or page_id % 7 = 5 then ' ' else 'a@href' end as rs_url,
  case page_id % 6 when 1 then ' 三体 ' when 2 then '' else null end as rs_check_key,
  case when page_id % 18 = 3 then null else 2 end as bi_keys, case when page_id % 18 = 3 or page_id % 5 = 2 then null else 'h1@text' end as bi_name, cast(null as string) as bi_author,
  case when page_id % 20 = 3 then null else 2 end as toc_keys, case when page_id % 20 = 3 or page_id % 9 = 4 then '' else '.chapter a' end as toc_list, 'text' as toc_name, 'href' as toc_url,
  case when page_id % 22 = 5 then null else 2 end as ct_keys, case when page_id % 22 = 5 or page_id % 6 = 4 then null else '#content' end as ct_content,
  case when page_id % 12 = 4 then 'FULL' else null end as ct_image, case page_id % 25 when 7 then 'm3u8' else null end as ct_regex
from t
"""

#: Statuses that an online run would have found, by modulus.
CONNECTIVITY_SQL = """case idx % 8 when 0 then 'NOT_CHECKED' when 1 then 'CONNECT_OK' when 2 then 'CONNECT_FORBIDDEN' when 3 then 'CONNECT_DEAD' when 4 then 'CONNECT_TIMEOUT' when 5 then 'CONNECT_ERROR' when 6 then 'NON_HTTP_SOURCE' else 'CONNECT_OK' end"""
SEARCH_SQL = """case idx % 7 when 0 then 'NOT_CHECKED' when 1 then 'SEARCH_HTTP_OK' when 2 then 'SEARCH_RULE_LIKELY_OK' when 3 then 'SEARCH_PARSE_OK' when 4 then 'SEARCH_COMPLEX_JS_SKIPPED' when 5 then 'SEARCH_UNVERIFIED' else 'SEARCH_TEMPLATE_COMPLEX' end"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = CATALOG_SQL.replace("{", "{{").replace("}", "}}").replace("from pages", "from {pages}")
    return spread(spark.sql(text, pages=table(spark, sf_dir, "pages")), "idx")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog with cleaned_name, url parts, classification, structure, availability and score."""
    df = names.clean_names(catalog(spark, sf_dir), url=F.col("url"), index=F.col("idx"))
    df = urls.with_url(df.withColumn("cleaned_name", F.col("clean.cleaned")))
    df = judge.classify(df)
    df = df.withColumns({"category": F.col("cls.category"), "confidence": F.col("cls.confidence")})
    df = df.withColumns({"structure": judge.structure(F.col("category")), "login": judge.login_status(), "connectivity": F.expr(CONNECTIVITY_SQL), "search_status": F.expr(SEARCH_SQL), "measured_respond_time": F.lit(None).cast("double")})
    df = df.withColumn("availability", judge.availability(F.col("structure.status"), F.col("login"), F.col("connectivity"), F.col("search_status"), F.col("search_url")))
    return judge.score(barrier(df), AS_OF)
