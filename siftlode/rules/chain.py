"""The chain search -> bookInfo -> toc -> content of every record against a page store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlode.functions import vocab
from siftlode.functions.plan import spread
from siftlode.functions.text import filled
from siftlode.operators import judge, probes, urls
from siftlode.rules.frames import extract_one


def _fetch(asked: DataFrame, pages: DataFrame) -> DataFrame:
    """asked + page, the body at its url where the fetch goes well, and failure, what goes wrong where it is live."""
    store = pages.select(F.col("url").alias("purl"), F.col("status").alias("http"), F.col("body").alias("page"))
    asked = asked.withColumn("refused", F.col("live") & probes.refused_url(F.when(F.col("live"), F.col("url"))))
    got = asked.join(store, F.when(F.col("live"), F.col("url")) == F.col("purl"), "left")
    error = F.when(F.col("refused"), "ssrf_blocked").when(F.col("purl").isNull(), "network_error")
    got = got.withColumn("failure", F.when(F.col("live"), probes.fetch_failure(F.col("http"), F.col("page"), error)))
    return got.withColumn("page", F.when(F.col("live") & F.col("failure").isNull(), F.col("page"))).drop("purl", "http", "refused")


def _advise(stage: str, reason: Column, also: Column | None = None) -> Column:
    out = also if also is not None else F.lit(None).cast("string")
    for (of, why), text in vocab.SUGGESTIONS.items():
        if of == stage:
            out = F.when(reason == why, text).otherwise(out)
    return out


def _stage(df: DataFrame, pages: DataFrame, stage: str, list_rule: Column | None, fields: dict[str, Column], urls_: tuple[str, ...], good: Column, found: Column, text: Column, missing: str, next_: Column, advice: Column | None = None) -> DataFrame:
    """df with the stage's result put behind `done`, and url and live as the next stage needs them."""
    x = extract_one(_fetch(df, pages), list_rule if list_rule is not None else F.lit(None).cast("string"), fields, "page", F.col("url"), urls_)
    went = F.col("failure").isNull()
    good = F.coalesce(good, F.lit(False))
    reason = F.when(~went, F.col("failure")).when(good, F.lit(None).cast("string")).when(F.col("got.error").isNotNull(), F.col("got.error")).when(F.col("got.n") == 0, "list_empty").otherwise(missing)
    detail = F.map_filter(F.create_map(*[v for n in fields for v in (F.lit(n), F.when(F.lit(n == "intro"), F.substring(f"got.first.{n}", 1, 200)).otherwise(F.col(f"got.first.{n}")))]), lambda _, v: v.isNotNull())
    row = F.struct(
        F.lit(stage).alias("stage"), F.when(went & good, "PASS").otherwise("FAIL").alias("status"), reason.alias("reason"), F.col("url").alias("url"), F.when(went, found).otherwise(0).cast("long").alias("found"),
        F.when(went, text).alias("text"), F.when(went, _advise(stage, reason, advice)).alias("suggestion"), F.when(went, F.coalesce(detail, F.create_map().cast("map<string,string>"))).alias("detail"))
    done = F.when(F.col("live"), F.array_append("done", row.cast(ROW))).otherwise(F.col("done"))
    live = F.col("live") & went & next_.isNotNull()
    return x.withColumns({"done": done, "live": F.coalesce(live, F.lit(False)), "url": F.when(F.col("live") & went, next_).otherwise(F.col("url"))}).drop("got", "failure")


ROW = "struct<stage:string,status:string,reason:string,url:string,found:bigint,text:string,suggestion:string,detail:map<string,string>>"


def verify_chain(catalog: DataFrame, pages: DataFrame, max_stage: str = "content", keyword=None) -> DataFrame:
    """catalog (flat columns, category) and pages (url, status, body; one row a url) -> idx, stage, status,
    reason, url, found, text, suggestion, detail, one row for each stage that a record came to.

    A record is one row all the way, which carries its results and its next url; a stage is one join with
    the page store on that url and one pass over the pages in their tasks, so nothing is worked out
    twice or regrouped.  Records without a list rule skip the search; what fails goes no further.
    """
    key = keyword if keyword is not None else judge.search_word(F.col("rs_check_key"), F.col("category"))
    rules = ("rs_list", "rs_name", "rs_author", "rs_url", "bi_name", "bi_author", "bi_intro", "bi_toc_url", "toc_list", "toc_name", "toc_url", "ct_content")
    skipped = F.struct(F.lit("search").alias("stage"), F.lit("SKIPPED").alias("status"), F.lit(None).cast("string").alias("reason"), F.col("url").alias("url"), F.lit(0).cast("long").alias("found"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("suggestion"), F.create_map().cast("map<string,string>").alias("detail"))
    live = filled(F.col("rs_list"))
    request = urls.search_request(F.col("search_url"), F.col("url"), key, F.lit(1))["url"]
    df = catalog.select("idx", request.alias("url"), *[F.col(c) if c in catalog.columns else F.lit(None).cast("string").alias(c) for c in rules])
    df = spread(df, "idx").withColumns({"live": live, "done": F.when(live, F.array().cast(f"array<{ROW}>")).otherwise(F.array(skipped.cast(ROW)))})
    first, some, rule = (lambda c: F.col(f"got.first.{c}")), (lambda c: F.col(f"got.some.{c}")), F.col
    stages = {
        "search": lambda d: _stage(d, pages, "search", rule("rs_list"), {"name": rule("rs_name"), "author": rule("rs_author"), "book_url": rule("rs_url")}, ("book_url",), some("book_url").isNotNull(), rule("got.n"), first("name"), "book_url_missing", some("book_url")),
        "bookInfo": lambda d: _stage(d, pages, "bookInfo", None, {"name": rule("bi_name"), "author": rule("bi_author"), "intro": rule("bi_intro"), "toc_url": rule("bi_toc_url")}, ("toc_url",), first("name").isNotNull(), first("name").isNotNull().cast("int"), first("name"), "name_empty",
                                     F.when(first("name").isNotNull(), F.coalesce(first("toc_url"), F.col("url"))), F.when(first("toc_url").isNull(), vocab.SUGGESTIONS["bookInfo", "no_toc_url"])),
        "toc": lambda d: _stage(d, pages, "toc", rule("toc_list"), {"title": rule("toc_name"), "chapter_url": rule("toc_url")}, ("chapter_url",), some("chapter_url").isNotNull(), rule("got.n"), first("title"), "chapter_url_missing", some("chapter_url")),
        "content": lambda d: _stage(d, pages, "content", None, {"content": rule("ct_content")}, (), F.length(first("content")) >= 20, F.coalesce(F.length(first("content")), F.lit(0)), F.substring(first("content"), 1, 200), "content_too_short", F.lit(None).cast("string"),
                                    F.when(F.length(first("content")) < 100, vocab.SUGGESTIONS["content", "short"])),
    }
    for name, step in stages.items():
        df = step(df)
        if name == max_stage:
            break
    out = df.select("idx", F.inline("done"))
    return out.withColumn("detail", F.when(F.col("stage") == "content", F.map_filter("detail", lambda k, _: k != "content")).otherwise(F.col("detail")))


def final_result(chain: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """verify_chain() rows -> idx, verified, stages, all_passed, summary: how many stages of a record passed.

    catalog (idx, name): names to put before the summary."""
    out = chain.groupBy("idx").agg(F.count_if(F.col("status") == "PASS").alias("verified"), F.count("*").alias("stages"))
    name = F.lit("")
    if catalog is not None:
        out = out.join(catalog.select(F.col("idx").alias("nidx"), F.col("name").alias("name")), F.col("idx") == F.col("nidx"), "left").drop("nidx")
        name = F.coalesce("name", F.lit(""))
    summary = F.concat(name, F.lit(": "), F.col("verified").cast("string"), F.lit("/"), F.col("stages").cast("string"), F.lit(" stages passed"))
    return out.select("idx", "verified", "stages", (F.col("verified") == F.col("stages")).alias("all_passed"), summary.alias("summary"))


def batch_results(catalog: DataFrame, chain: DataFrame | None, mode: str = "fast") -> DataFrame:
    """Outcome of each record: catalog (with structure, login, availability, risks, norm) and its chain rows
    -> idx, grp, type, host, mode, stages, reasons, warnings, suggestions, first_failure_stage, status."""
    empty, none = F.array().cast("array<struct<stage:string,status:string>>"), F.array().cast("array<string>")
    if chain is None:
        rows = catalog.withColumns({"stages": empty, "said": none, "suggestions": none})
    else:
        order = F.array_position(F.array(*map(F.lit, probes.STAGES)), F.col("stage"))
        per = chain.groupBy("idx").agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), "stage", "status", "reason", "suggestion"))).alias("r"))
        per = per.select(F.col("idx").alias("cidx"), F.transform("r", lambda x: F.struct(x["stage"].alias("stage"), x["status"].alias("status"))).alias("stages"), F.array_compact(F.col("r.reason")).alias("said"), F.array_compact(F.col("r.suggestion")).alias("suggestions"))
        rows = catalog.join(per, catalog.idx == per.cidx, "left").withColumns({"stages": F.coalesce("stages", empty), "said": F.coalesce("said", none), "suggestions": F.coalesce("suggestions", none)})
    args = (F.col("structure.status"), F.col("search_url"), F.col("url"))
    failed = F.get(F.filter("stages", lambda s: ~s["status"].isin("PASS", "SKIPPED")), F.lit(0))["stage"]
    return rows.select("idx", "grp", "type", F.col("norm.normalized_host").alias("host"), F.lit(mode).alias("mode"), "stages", probes.batch_reasons(*args, F.col("said")).alias("reasons"), F.col("norm.url_warnings").alias("warnings"), "suggestions",
                       failed.alias("first_failure_stage"), probes.batch_status(*args, F.col("said"), F.col("login"), F.col("availability"), F.col("stages"), F.col("risks")).alias("status"))
