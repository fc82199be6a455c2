"""URL filters by Bloom filter cascades (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlode.llm.bloom import Bloom
from siftlode.llm.common import cut, drop, files_for, small, wave

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
#: Names reserved by RFC 2606 and RFC 6761: never a public page.
RESERVED = ("test/", "invalid/", "localhost/", "local/")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substring(url, F.instr(url, "://") + 3, F.length(url)), "?", 1))
    rest = F.coalesce(F.substring_index(rest, "#", 1), F.lit(""))
    host = F.translate(F.substring_index(rest, "/", 1), UPPER, LOWER)
    path = F.substring(rest, F.length(F.substring_index(rest, "/", 1)) + 1, F.length(rest))
    return host, path


def candidate_keys(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """Every key that a listed rule for this host and path could have: each host suffix of at most
    `labels` labels by each path prefix of a listed length."""
    have = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    hosts = F.array_compact(F.array(*[F.when(have >= i, F.substring_index(host, ".", -i)) for i in range(1, labels + 1)]))
    by = F.array_compact(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]))
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(by, lambda p: F.concat(h, p))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(keys)


def listed(spark: SparkSession, rules: tuple[tuple[str, str], ...] = RULES, own_block: tuple[str, ...] = RESERVED) -> DataFrame:
    """The rules of the program as a list (key, side); real lists are tables of that form."""
    rows = [(k, v) for k, v in rules] + [(k, "own") for k in own_block]
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("side")) for k, v in rows])))


def build_cascade(universe: DataFrame, flag: str, max_levels: int = 60) -> list[Bloom]:
    """Levels of a cascade that says for every key of universe (key, <flag> boolean) whether it is
    listed.  Level 1 holds the listed keys; level i + 1 holds the keys of the other side that level i
    passes wrongly, and is tested against the side level i held; it ends when none passes wrongly.

    Level 1's rate is chosen to pass about as many keys wrongly as are listed, so the size of every
    level follows the list, not the universe."""
    held, others = universe.where(flag), universe.where(~F.col(flag))
    levels: list[Bloom] = []
    made: list[DataFrame] = []
    n = held.count()
    rate = min(0.5, n / max(1, others.count() * math.sqrt(2))) if n else 0.5
    while n:
        if len(levels) == max_levels:
            raise RuntimeError("the cascade does not end")
        level = Bloom(held, n, rate if not levels else 0.5, seed=len(levels) + 1)
        levels.append(level)
        wrong = cut(others.where(level.has(F.col("key"))).select("key"))
        made.append(wrong)
        held, others, n = wrong, held, wrong.count()
    drop(*made)
    return levels


def in_cascade(levels: list[Bloom], key: Column) -> Column:
    """Exact for keys of the universe that the levels were built over."""
    out = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels), 0, -1):
        out = F.when(levels[i - 1].has(key), out).otherwise(F.lit(i % 2 == 0))
    return out


def filter_urls(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """pages (page_id, url, ...), rules (key `host/path`, side: allow, block or own; by default listed())
    -> page_id, url, host, path, rule, verdict, decided_by.

    A rule `host/path` fits its host and all subdomains where the url's path starts with the rule's;
    the longest fitting rule wins (of equal length, the greater string), and a key listed both ways
    is blocked.  Urls that no rule fits are blocked if a key of side own fits, else allowed.  Null keys,
    keys without a slash and other sides are ignored.

    All keys that any url of the corpus could match form the key universe (one aggregation, with
    partial sums, so hot keys are combined before the shuffle); a url has one for each listed path
    length and host suffix of as many labels as a listed host has at most, however long its host is.
    Over it one cascade is built for the allowed, the blocked and the own keys; urls are then judged by
    bit tests alone, without a join.  Null url, or one without `://`: empty host and path, no rule.
    Repeated rows are judged alike, an empty table gives no rows, other columns are ignored.
    """
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rules = (listed(pages.sparkSession) if rules is None else rules).where("instr(key, '/') > 0").select(F.col("key").alias("rule"), "side")
    sides = ("allow", "block", "own")
    known = cut(rules.groupBy("rule").agg(*(F.coalesce(F.max(F.col("side") == side), F.lit(False)).alias(side) for side in sides)), wave(pages.sparkSession))
    name = F.substring_index("rule", "/", 1)
    # numbers only: the most labels of a host, and the different lengths of paths, at most as many as the longest
    most = known.agg(F.count("*").alias("rules"), F.max(F.length(name) - F.length(F.replace(name, F.lit("."), F.lit(""))) + 1).alias("labels"), F.collect_set(F.length("rule") - F.length(name)).alias("lengths")).first()
    urls = urls.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), most.labels or 0, sorted(most.lengths)) if most.rules else F.array().cast("array<string>"))
    keys = urls.select(F.explode("keys").alias("key")).groupBy("key").agg(F.lit(1).alias("one"))
    universe = keys.join(small(known, most.rules), F.col("key") == F.col("rule"), "left").select("key", *(F.coalesce(side, F.lit(False)).alias(side) for side in sides))
    universe = cut(universe, files_for(pages))
    drop(known)
    cascade = {side: build_cascade(universe, side) for side in sides}
    drop(universe)

    def best(side: str) -> Column:
        hits = F.filter("keys", lambda k: in_cascade(cascade[side], k))
        return F.array_max(F.transform(hits, lambda k: F.struct(F.length(k).alias("n"), k.alias("key")))) if cascade[side] else F.lit(None).cast("struct<n:int,key:string>")

    judged = urls.select("page_id", "url", "host", "path", best("allow").alias("a"), best("block").alias("b"), best("own").alias("o"))
    judged = judged.withColumn("hit", F.greatest("a", "b"))
    verdict = F.when(F.col("hit").isNotNull(), F.when(F.col("hit").eqNullSafe(F.col("b")), "block").otherwise("allow"))
    verdict = verdict.otherwise(F.when(F.col("o").isNotNull(), "block").otherwise("allow"))
    by = F.when(F.col("hit").isNotNull(), "rule").when(F.col("o").isNotNull(), "reserved").otherwise("default")
    return judged.select("page_id", "url", "host", "path", F.col("hit.key").alias("rule"), verdict.alias("verdict"), by.alias("decided_by"))
