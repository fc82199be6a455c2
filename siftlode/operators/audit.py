"""Counts of a catalog, and checks of what a run wrote."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlode.functions.text import ascii_bounded, matches, natural_key
from siftlode.functions import vocab
from siftlode.operators.judge import file_key
from siftlode.operators.names import dirty_issues


def zone_stats(df: DataFrame) -> DataFrame:
    """(zone, metric, value, n): counts by category, availability and type, and mean respond times,
    over all rows and over those kept.  One aggregation; each row meets its six counters as an array."""
    rt = F.col("respond_time")
    zones = df.select("respond_time", "measured_respond_time", "category", "availability", F.coalesce(F.col("type").cast("string"), F.lit("-1")).alias("kind"),
                      F.explode(F.when(F.col("kept"), F.array(F.lit("all"), F.lit("kept"))).otherwise(F.array(F.lit("all")))).alias("zone"))
    long = zones.select("zone", "respond_time", "measured_respond_time", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in (("total", F.lit("")), ("category", F.col("category")), ("availability", F.col("availability")), ("type", F.col("kind")))])))
    g = long.groupBy("zone", "metric", "value").agg(F.count("*").alias("n"), F.round(F.avg(F.when(rt >= 0, rt))).cast("long").alias("rt"), F.round(F.avg(F.when(F.col("measured_respond_time") >= 0, F.col("measured_respond_time")))).cast("long").alias("mrt"))
    means = g.where("metric = 'total'").select("zone", F.inline(F.array(F.struct(F.lit("average_respond_time").alias("metric"), F.coalesce("rt", F.lit(0)).alias("n")), F.struct(F.lit("measured_average_respond_time").alias("metric"), F.col("mrt").alias("n")))))
    return g.select("zone", "metric", "value", "n").unionByName(means.select("zone", "metric", F.lit("").alias("value"), "n"))


def count_by(df: DataFrame, column: str, label: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(label)).alias(column)).agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"))


def top_groups(df: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent groups; of equals the one seen first."""
    return count_by(df.withColumn("grp", F.nullif("grp", F.lit(""))), "grp", "(none)").orderBy(F.desc("n"), "first_idx").limit(k)


def inspect_flags(df: DataFrame) -> DataFrame:
    """One row: records, and how many have emoji names, non-HTTP urls, scripts in their search."""
    js = "(?i)" + "|".join(ascii_bounded(p) for p in vocab.INSPECT_JS)
    emoji = r"[\x{1F600}-\x{1F6FF}\x{2600}-\x{27BF}]"
    return df.agg(F.count("*").alias("records"), F.count_if(matches(F.col("name"), emoji)).alias("emoji"), F.count_if(F.coalesce((F.col("url") != "") & ~F.col("url").rlike("(?i)^https?://"), F.lit(False))).alias("non_http"), F.count_if(matches(F.col("search_url"), js)).alias("complex_js"))


def dirty_names(out: DataFrame) -> DataFrame:
    """Output rows (idx, name, url, category) whose name is not clean."""
    issues = dirty_issues(F.col("name"))
    return out.withColumn("issues", F.array_join(issues, ", ")).where("issues <> ''").select(F.concat(file_key(F.col("category")), F.lit(".json")).alias("file"), "idx", "name", "url", "issues", F.concat(F.lit("Remove: "), F.col("issues")).alias("suggestion"))


def group_mismatches(groups: DataFrame) -> DataFrame:
    """Rows (idx, name, url, grp, file_key) whose first tag is not their file's category."""
    expected = F.lit(None).cast("string")
    for category, key in vocab.FILE_KEYS.items():
        expected = F.when(F.col("file_key") == key, category).otherwise(expected)
    tag = F.trim(F.element_at(F.split(F.coalesce("grp", F.lit("")), ","), 1))
    return groups.withColumns({"expected": expected, "tag": tag}).where("tag <> '' and tag <> expected").select(F.concat("file_key", F.lit(".json")).alias("file"), "idx", "name", "url", "tag", "expected")


def group_diffs(cleaned: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of one idx that say different things in the two outputs."""
    g = groups.select(F.col("idx").alias("gidx"), F.col("name").alias("group_name"), F.col("grp").alias("group_grp"), F.col("url").alias("group_url"), F.col("file_key").alias("group_file"))
    both = cleaned.join(g, cleaned.idx == g.gidx)
    same = F.col("name").eqNullSafe(F.col("group_name")) & F.col("grp").eqNullSafe(F.col("group_grp")) & F.col("url").eqNullSafe(F.col("group_url"))
    return both.where(~same).select("idx", "name", "group_name", "grp", "group_grp", "url", "group_url", F.concat("group_file", F.lit(".json")).alias("file"))


def checks(reviewed: DataFrame, cleaned: DataFrame, groups: DataFrame, summary_input: int, summary_output: int) -> DataFrame:
    """One row a check: id, pass, n (what was found), expected.  reviewed has every input row."""
    spark = reviewed.sparkSession
    key = F.lit(1).alias("k")
    c = cleaned.agg(F.count("*").alias("c_n"), F.count_if(F.col("idx").isNull()).alias("c_null"), (F.count("idx") - F.count_distinct("idx")).alias("c_dup"), F.count_if(F.col("availability").isin("dead", "timeout", "forbidden")).alias("c_gone")).withColumn("k", key)
    g = groups.agg(F.count("*").alias("g_n"), F.count_if(F.col("idx").isNull()).alias("g_null"), (F.count("idx") - F.count_distinct("idx")).alias("g_dup"), F.count_if(F.col("file_key") != file_key(F.col("category"))).alias("g_file")).withColumn("k", key)
    r = reviewed.agg(F.count("*").alias("r_n"), F.count_if(~F.col("kept") & F.col("removed_reason").isNull()).alias("r_why")).withColumn("k", key)
    miss = cleaned.select("idx").join(groups.select("idx"), "idx", "left_anti").unionByName(groups.select("idx").join(cleaned.select("idx"), "idx", "left_anti")).agg(F.count("*").alias("m_n")).withColumn("k", key)
    diff = group_diffs(cleaned, groups).agg(F.count("*").alias("d_n")).withColumn("k", key)
    tags = group_mismatches(groups).agg(F.count("*").alias("t_n")).withColumn("k", key)
    dirty = dirty_names(groups).agg(F.count("*").alias("n_dirty")).withColumn("k", key)
    one = c
    for x in (g, r, miss, diff, tags, dirty):
        one = one.join(x, "k")
    sin, sout = F.lit(summary_input), F.lit(summary_output)
    zero = F.lit(0)
    rows = [
        ("count-match", F.col("c_n"), sout), ("groups-total-equals-cleaned", F.col("g_n"), F.col("c_n")), ("cleaned-has-original-index", F.col("c_null"), zero), ("groups-has-original-index", F.col("g_null"), zero),
        ("cleaned-no-dup-index", F.col("c_dup"), zero), ("groups-no-dup-index", F.col("g_dup"), zero), ("index-sets-match", F.col("m_n"), zero), ("same-index-same-fields", F.col("d_n"), zero),
        ("file-category-matches", F.col("g_file"), zero), ("group-tag-matches-file", F.col("t_n"), zero), ("dirty-names-in-groups", F.col("n_dirty"), zero), ("no-unavailable-in-default", F.col("c_gone"), zero),
        ("input-total", sin, F.col("r_n")), ("output-total", sout, F.col("c_n")), ("sources-count", F.col("r_n"), sin), ("removed-reason", F.col("r_why"), zero),
    ]
    return one.select(F.inline(F.array(*[F.struct(F.lit(i).alias("id"), (n == e).alias("pass"), n.cast("long").alias("n"), e.cast("long").alias("expected")) for i, n, e in rows])))


def matching(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Rows of which some column holds its text, whatever the case; without texts, all rows."""
    hits = [F.coalesce(F.contains(F.lower(F.col(c)), F.lit(text.lower())), F.lit(False)) for c, text in wanted.items() if text]
    return df.where(reduce(or_, hits)) if hits else df


def page(df: DataFrame, by: str, ties: tuple[str, ...], start: int, size: int, descending: bool = False, natural: bool = False) -> DataFrame:
    """size rows from start on, in the order of a column with nulls last, then of ties.  natural: numbers inside
    texts by their values."""
    key = natural_key(F.col(by).cast("string")) if natural else F.col(by)
    first = key.desc_nulls_last() if descending else key.asc_nulls_last()
    return df.orderBy(first, *[F.col(c).asc_nulls_last() for c in ties]).offset(start).limit(size)


def repeated(df: DataFrame, key: Column, id_: str) -> DataFrame:
    """(key, n, first) of keys that several rows share."""
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min(id_).alias("first")).where("n > 1 and key is not null")
