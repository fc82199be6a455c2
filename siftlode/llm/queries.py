"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlode.llm import audio, crosstok, embeddings, interactions, langid, licenses, mainpart, mixing, packing, quality, simhash, suffixes, urlfilter


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    fold = langid.fold(F.col("doc_id"), 4)
    profiles = langid.learn(docs.select("doc_id", "text", "lang").where(fold != 2))
    return langid.identify(docs, profiles).select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(_read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "decided_by")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = suffixes.repeated_spans(_read(spark, sf_dir, "documents"))
    return spans.select("doc_id", "start_word", "end_word", "removed", "first_doc_id")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op5_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(_read(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "repeats", "taken")


def op8_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    fold = langid.fold(F.col("doc_id"), 5)
    model = quality.learn(docs, _read(spark, sf_dir, "labels").where(fold != 0))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op9_audio_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = audio.media_columns(_read(spark, sf_dir, "documents"))
    return media.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.col("n_tensors").cast("string"), F.sha2("features", 256)).alias("feature"),
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = interactions.failures(_read(spark, sf_dir, "documents"))
    steps = interactions.audit(interactions.marked(flagged, _read(spark, sf_dir, "labels")))
    return steps.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstok.aligned_documents(_read(spark, sf_dir, "documents"))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainpart.extract(_read(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_url_filters, op3_suffix_dedup, op4_embedding_dedup, op5_bestfit_packing, op6_license_scans, op7_source_mixing, op8_quality_gam, op9_audio_media, op10_simhash, op11_filter_interactions, op12_token_alignment, op13_main_text)}

UPPER, LOWER = licenses.UPPER, licenses.LOWER
_TEMPLATES = ", ".join(f"({t}, {str(t < len(licenses.BASE_PHRASES)).lower()}, '{label}', '{words}')" for t, (words, label) in enumerate((*licenses.BASE_PHRASES, *licenses.PASSAGES)))

ORACLE_SQL = {
    "op11_filter_interactions": r"""
with recursive d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
lab as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
o(ord, k) as (select '', 0 union all select ord || f, k + 1 from o, (values ('A'), ('B'), ('C'), ('D'), ('E')) v(f) where k < 5 and position(f in ord) = 0),
fails as (
  select d.doc_id, part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    (case when len(w) < 200 then 'A' else '' end) || (case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end) || (case when 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t) then 'C' else '' end)
    || (case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end) || (case when d.doc_id > min(d.doc_id) over (partition by t) then 'E' else '' end) as failed
  from d left join lab using (doc_id)),
same as (select part, failed, count(*) as n, sum(good) as good, sum(toxic) as toxic from fails group by part, failed),
walk as (
  select part, failed, n, good, toxic, ord, s as step, substr(ord, s, 1) as f, regexp_matches(substr(ord, 1, s - 1), '[' || failed || '0]') as gone, position(substr(ord, s, 1) in failed) > 0 as fail
  from same, (select ord from o where k = 5), (select unnest(range(1, 6)) as s)),
told as (
  select part, ord as filter_order, step, f, sum(case when gone or fail then 0 else n end) as kept, sum(case when fail and not gone then n else 0 end) as removed, sum(case when fail and gone then n else 0 end) as redundant,
    sum(case when failed = f then n else 0 end) as unique_fails, sum(case when fail and not gone then good else 0 end) as good_lost, sum(case when fail and not gone then toxic else 0 end) as toxic_lost
  from walk group by all)
select part, filter_order, cast(step as int) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
  cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, f) as bigint) as shapley from told""",
    "op3_suffix_dedup": rf"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') as w from documents),
g as (select doc_id, s, md5(array_to_string(w[s + 1 : s + 50], ' ')) as k from (select doc_id, w, unnest(range(greatest(len(w) - 49, 0))) as s from w)),
f as (select k, min(doc_id) as first from g group by k having count(distinct doc_id) > 1),
h as (select distinct doc_id, s, first, first < doc_id as removed from g join f using (k)),
n as (select *, case when s > lag(s) over (partition by doc_id, removed order by s) + 50 then 1 else 0 end as new from h),
i as (select *, sum(new) over (partition by doc_id, removed order by s rows between unbounded preceding and current row) as span from n)
select doc_id, cast(min(s) as int) as start_word, cast(max(s) + 50 as int) as end_word, removed, min(first) as first_doc_id from i group by doc_id, removed, span""",
    "op4_embedding_dedup": """
with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings),
ok as (select * from v where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) as (select a, b from l union select r.a, l.b from reach r join l on r.b = l.a),
c as (select a, min(least(a, b)) as component_id from reach group by a), d as (select a, count(*) as n_links from l group by a)
select vec_id, coalesce(n_links, 0) as n_links, coalesce(component_id, vec_id) as component_id, coalesce(component_id, vec_id) = vec_id as kept from v left join c on c.a = vec_id left join d on d.a = vec_id""",
    "op6_license_scans": rf"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
t(t, exact, label, words) as (values {_TEMPLATES}), u as (select t, exact, label, string_split(words, ' ') as w, unnest(range(len(string_split(words, ' ')) - 1)) as tpos from t),
p as (select doc_id, w, unnest(range(greatest(len(w) - 1, 0))) as pos from d),
hit as (select doc_id, t, exact, label, len(u.w) - 1 as tlen, pos - tpos as diagonal, tpos from p join u on p.w[pos + 1] = u.w[tpos + 1] and p.w[pos + 2] = u.w[tpos + 2]),
vote as (select doc_id, t, exact, label, tlen, diagonal, list(distinct tpos) as seen, min(diagonal + tpos) as start, max(diagonal + tpos) + 2 as stop from hit group by all having not exact or count(*) = tlen),
new as (select *, case when exact or coalesce(diagonal - lag(diagonal) over (partition by doc_id, t order by diagonal) > 3, true) then 1 else 0 end as new from vote),
chain as (select *, sum(new) over (partition by doc_id, t order by diagonal rows between unbounded preceding and current row) as span from new),
merged as (select doc_id, t, exact, label, tlen, span, min(start) as start, max(stop) as stop, len(list_distinct(flatten(list(seen)))) / any_value(tlen) as cover from chain group by doc_id, t, exact, label, tlen, span),
good as (select *, exact or (cover >= 0.8 and stop - start <= 2 * (tlen + 2)) as whole from merged),
spans as (select doc_id, exact, label, start, cover from good where whole union all select c.doc_id, c.exact, c.label, c.start, len(c.seen) / c.tlen from chain c join good g using (doc_id, t, span) where not g.whole and len(c.seen) / c.tlen >= 0.8)
select d.doc_id, cast(any_value(len(w)) as bigint) as n_words, count(*) filter (where exact) as n_base, min(start) filter (where exact) as first_word, max(start) filter (where exact) as last_word,
  coalesce(array_to_string(list_sort(list(distinct label) filter (where exact)), ','), '') as base_labels, coalesce(array_to_string(list_sort(list(distinct label) filter (where label is not null)), ','), '') as labels, coalesce(max(cover), 0.0) as score
from d left join spans using (doc_id) group by d.doc_id""",
    "op2_url_filters": r"""
with u as (
  select page_id, case when position('://' in url) > 0 then regexp_extract(substr(url, position('://' in url) + 3), '^[^?#]*') else '' end as rest from pages
), s as (
  select page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(rest, ''), '/.*$', 0, 's') as path from u
), r as (
  select *, case
    when (host = 'www.example.com' or host like '%.www.example.com') and starts_with(path, '/en/') then 'www.example.com/en/'
    when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/en/') then 'example.com/en/'
    when (host = 'net' or host like '%.net') and starts_with(path, '/es/') then 'net/es/'
    when (host = 'net' or host like '%.net') and starts_with(path, '/fr/') then 'net/fr/'
    when (host = 'com' or host like '%.com') and starts_with(path, '/') then 'com/' end as rule,
    regexp_matches(host, '(^|\.)(test|invalid|localhost|local)$') and starts_with(path, '/') as reserved
  from s
)
select page_id, host, path, rule,
  case when rule in ('example.com/en/', 'net/es/', 'net/fr/') then 'block' when rule is not null then 'allow' when reserved then 'block' else 'allow' end as verdict,
  case when rule is not null then 'rule' when reserved then 'reserved' else 'default' end as decided_by
from r""",
}
