"""Duplicates at five levels: keys, one survivor a key, risk veto, group rows and field differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlode.functions import vocab
from siftlode.functions.plan import barrier, holding, numbered, opaque
from siftlode.functions.text import matches, trim
from siftlode.operators import urls
from siftlode.operators.judge import rule_fields

LEVELS = ("none", "exact", "url", "conservative", "host", "aggressive")


def key(level: str) -> Column:
    """Key of a level over name, cleaned_name, url, type, category; null: never a duplicate.
    __candidate is the stripped url."""
    ukey = urls.url_key(F.col("url"), F.col("__candidate"))
    url, kind = F.col("url"), F.col("type").cast("string")
    name = F.coalesce(F.nullif(F.col("cleaned_name"), F.lit("")), F.nullif(F.col("name"), F.lit("")), url, F.lit(""))
    low = trim(F.lower(name))
    web = matches(url, "(?i)^https?://")
    site = urls.normalize_url(url, F.col("__candidate"))["normalized_host"]
    found = {
        "none": F.lit(None).cast("string"),
        "exact": F.lower(trim(url)),
        "url": ukey,
        "conservative": F.coalesce(F.when(ukey.isNotNull(), F.concat_ws(":", ukey, F.col("category"), F.coalesce(kind, F.lit("x")))), F.concat_ws(":", F.lit("conservative-nonhttp"), F.coalesce(kind, F.lit("-1")), F.col("category"), low)),
        "host": F.when(web, site).otherwise(F.concat_ws(":", F.lit("non-http"), F.coalesce(kind, F.lit("-1")), low)),
        "aggressive": F.when(web, F.concat_ws("::", site, F.lower(F.coalesce(F.nullif(F.col("cleaned_name"), F.lit("")), F.nullif(F.col("name"), F.lit("")))))).otherwise(F.concat_ws(":", F.lit("non-http-aggressive"), F.coalesce(kind, F.lit("-1")), low)),
    }[level]
    return F.nullif(found, F.lit(""))


def availability_rank(c: Column) -> Column:
    out = F.lit(99)
    for status, rank in vocab.AVAILABILITY_RANK.items():
        out = F.when(c == status, rank).otherwise(out)
    return out


def survivor_order() -> Column:
    """What rows of a key are ordered by, the survivor first: a struct to be compared in ascending order."""
    big = F.lit(float("inf"))
    return F.struct(
        (-F.col("score")).alias("score"), availability_rank(F.col("availability")).alias("availability"), F.coalesce("respond_time", big).alias("respond_time"),
        (-F.coalesce("last_update_time", F.lit(0))).alias("last_update_time"), (-F.coalesce("weight", F.lit(0.0))).alias("weight"), (-rule_fields()).alias("rules"), F.col("idx").alias("idx"))


#: Columns of the survivor that other rows of its key are held against.
SURVIVOR = ("idx", "name", "score", "category", "type", "availability", "rs_list", "rs_name", "rs_url", "bi_name", "toc_list", "ct_content", "last_update_time", "respond_time")


def keyed(df: DataFrame, level: str) -> DataFrame:
    df = df.withColumn("__candidate", urls.strip_decorations(F.col("url"))).withColumn("dedupe_key", key(level)).drop("__candidate")
    return opaque(barrier(df), "dedupe_key")


def dedupe(df: DataFrame, level: str = "conservative", allow_risky: bool = False) -> DataFrame:
    """df + dedupe_key, dup_size, dup_first_idx, dup_risk, dup_kept and survivor columns (k.*).

    The survivor, the size and the conflicts of a key are sums, combined before the shuffle; they meet
    the rows again in an equi-join whose hot side the adaptive planner can split, so no key's rows are
    gathered in a task.  Rows without a key are groups of their own.  df is read twice: persist it where
    it is dear.  ranked() adds the places within groups.
    """
    df = keyed(df, level)
    best = F.min_by(F.struct(*SURVIVOR), survivor_order())
    # a conflict with the survivor is one within the group
    kind = F.struct(F.coalesce("category", F.lit("\x00")).alias("c"), F.coalesce(F.col("type").cast("string"), F.lit("\x00")).alias("t"))
    per = df.where("dedupe_key is not null").groupBy(F.col("dedupe_key").alias("__key")).agg(best.alias("__k"), F.count("*").alias("__size"), F.min("idx").alias("__first"), (F.min(kind) != F.max(kind)).alias("__mixed"))
    risky = F.col("__mixed") if level in ("host", "aggressive") and not allow_risky else F.lit(False)
    out = df.join(per, F.col("dedupe_key") == F.col("__key"), "left")
    out = out.withColumns({"k": F.coalesce("__k", F.struct(*SURVIVOR)), "dup_size": F.coalesce("__size", F.lit(1)), "dup_first_idx": F.coalesce("__first", "idx"), "dup_risk": F.coalesce(risky & (F.col("__size") > 1), F.lit(False))})
    return out.withColumn("dup_kept", (F.col("idx") == F.col("k.idx")) | F.col("dup_risk")).drop("__key", "__k", "__size", "__first", "__mixed")


def ranked(marked: DataFrame) -> DataFrame:
    """marked + dup_rank, a row's place in its group from 1 on.

    For tables that show it; nothing else asks for it, as a group is one window partition here (which spills)."""
    part = F.coalesce("dedupe_key", F.concat(F.lit("\x00"), F.col("idx").cast("string")))
    ordered = marked.withColumns({"__part": part, "__order": survivor_order()})
    return ordered.withColumn("dup_rank", F.row_number().over(Window.partitionBy("__part").orderBy("__order"))).drop("__part", "__order")


def survivors(df: DataFrame, level: str) -> DataFrame:
    """Only the best row of each key (and rows without one); combined on each side of the shuffle."""
    df = keyed(df, level).withColumn("dedupe_key", F.coalesce("dedupe_key", F.concat(F.lit("\x00"), F.col("idx").cast("string"))))
    ranked_ = df.withColumn("dup_rank", F.row_number().over(Window.partitionBy("dedupe_key").orderBy(survivor_order())))
    return ranked_.where("dup_rank = 1").drop("dup_rank")


def removed_reason() -> Column:
    yes = lambda c: F.when(c, "yes").otherwise("no")
    return F.when(~F.col("dup_kept"), F.concat(
        F.lit('Duplicate of "'), F.col("k.name"), F.lit('" (score diff: '), (F.col("k.score") - F.col("score")).cast("string"),
        F.lit(", same category: "), yes(F.col("category").eqNullSafe(F.col("k.category"))), F.lit(", same type: "), yes(F.col("type").eqNullSafe(F.col("k.type"))), F.lit(")")))


def field_diff(marked: DataFrame) -> DataFrame:
    """One row for each member of a group but its survivor, with what differs and, to sort by, its place."""
    k = lambda c: F.col(f"k.{c}")
    rules = (("rs_list", "ruleSearch.bookList"), ("rs_name", "ruleSearch.name"), ("rs_url", "ruleSearch.bookUrl"), ("bi_name", "ruleBookInfo.name"), ("toc_list", "ruleToc.chapterList"), ("ct_content", "ruleContent.content"))
    differ = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(k(c)), F.lit(n)) for c, n in rules]))
    mine, kept = F.coalesce("last_update_time", F.lit(0)), F.coalesce(k("last_update_time"), F.lit(0))
    fresh = F.when(mine > kept, F.concat(F.lit("removed is newer ("), mine.cast("string"), F.lit(" > "), kept.cast("string"), F.lit(")"))).when(mine < kept, "kept is newer").otherwise("same freshness")
    big = F.lit(float("inf"))
    rt, krt = F.coalesce("respond_time", big), F.coalesce(k("respond_time"), big)
    speed = F.when(rt < krt, F.concat(F.lit("removed responds faster ("), rt.cast("long").cast("string"), F.lit("ms < "), F.coalesce(k("respond_time").cast("long").cast("string"), F.lit("Infinity")), F.lit("ms)"))).when(rt > krt, "kept responds faster").otherwise("same respondTime")
    why = lambda s, a: F.concat(F.lit("score: "), s.cast("string"), F.lit(", availability: "), a)
    return marked.where("dup_size > 1 and idx <> k.idx").select(
        "dedupe_key", "dup_first_idx", "dup_size", survivor_order().alias("place"), "dup_risk", k("idx").alias("kept_idx"), k("name").alias("kept_name"), F.col("idx").alias("removed_idx"), F.col("name").alias("removed_name"),
        (k("score") - F.col("score")).alias("score_diff"), (~F.col("type").eqNullSafe(k("type"))).alias("type_conflict"), (~F.col("category").eqNullSafe(k("category"))).alias("category_conflict"),
        F.array_join(differ, "; ").alias("rule_differences"), fresh.alias("freshness"), speed.alias("respond_speed"),
        why(k("score"), k("availability")).alias("why_kept"), why(F.col("score"), F.col("availability")).alias("why_removed"), k("category").alias("kept_category"), F.col("category").alias("removed_category"))


#: Members that one row of listed() names; larger groups go on in further rows.
LISTED = 10_000


def groups(marked: DataFrame, level: str) -> DataFrame:
    """One row a group: group_id by first appearance, group_key, kept_idx, kept_name, size, dup_risk, reason."""
    note = F.concat(F.col("dedupe_key"), F.when(F.col("dup_risk"), F.lit(" (RISK: type/category conflict — NOT auto-removed)")).otherwise(F.lit("")))
    reason = F.when(F.col("dup_risk"), F.lit("dedupe-risk: host matched but type/category differs — kept all")).otherwise(F.lit(vocab.DEDUPE_REASON.get(level, "unknown")))
    g = marked.where("dup_size > 1 and idx = k.idx").select("dedupe_key", "dup_first_idx", note.alias("group_key"), F.col("idx").alias("kept_idx"), F.col("name").alias("kept_name"), F.col("dup_size").alias("size"), "dup_risk", reason.alias("reason"))
    out = numbered(g, "dup_first_idx", into="group_id")
    return holding(out.drop("dup_first_idx"), out)


def listed(marked: DataFrame, found: DataFrame) -> DataFrame:
    """groups() with their removed members and differences as lists, in order, about LISTED at most in a
    row: part counts the rows of a group, so a group of any size is told in full."""
    rows = field_diff(marked).withColumn("part", F.pmod(F.xxhash64("removed_idx"), F.ceil(F.col("dup_size") / LISTED)).cast("int"))
    gone = F.sort_array(F.collect_list(F.when(~F.col("dup_risk"), F.struct("place", "removed_idx", "removed_name", "score_diff"))))
    diffs = F.sort_array(F.collect_list(F.struct("place", "removed_idx", "type_conflict", "category_conflict", "rule_differences", "freshness", "respond_speed", "why_kept", "why_removed")))
    lists = rows.groupBy(F.col("dedupe_key").alias("__key"), "part").agg(gone.alias("gone"), diffs.alias("diffs"))
    both = found.join(lists, F.col("dedupe_key") == F.col("__key"))
    return both.select("group_id", "part", "group_key", "kept_idx", "kept_name", "size", "dup_risk", "reason", F.col("gone.removed_idx").alias("removed_indices"), F.col("gone.removed_name").alias("removed_names"),
                       F.col("gone.score_diff").alias("score_diffs"), F.transform("diffs", lambda d: d.dropFields("place")).alias("diffs"))


def removed(marked: DataFrame) -> DataFrame:
    """__key, removed: the indices of a group's removed members in order, as one text; one row a group that loses any.

    Places come from a window, which spills; LISTED members at a time become text, so no task holds a group's rows."""
    gone = ranked(marked.where("dup_size > 1 and idx <> k.idx and not dup_risk"))
    texts = gone.groupBy("dedupe_key", F.floor((F.col("dup_rank") - 1) / LISTED).alias("part")).agg(F.sort_array(F.collect_list(F.struct("dup_rank", "idx"))).alias("x"))
    texts = texts.select("dedupe_key", "part", F.array_join(F.transform("x", lambda m: m["idx"].cast("string")), ",").alias("text"))
    parts = texts.groupBy(F.col("dedupe_key").alias("__key")).agg(F.sort_array(F.collect_list(F.struct("part", "text"))).alias("parts"))
    return parts.select("__key", F.array_join(F.col("parts.text"), ",").alias("removed"))


def pairs(marked: DataFrame) -> DataFrame:
    """Each group's survivor beside each other member; a group kept for its conflicts is of high risk."""
    return field_diff(marked).select("dedupe_key", "kept_idx", "removed_idx", "kept_name", "removed_name", "kept_category", "removed_category", "rule_differences", "type_conflict", F.when(F.col("dup_risk"), "high").otherwise("low").alias("risk"))
