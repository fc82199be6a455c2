"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlode.llm.common import cut, drop, small, wave

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the hash that each refinement adds; the last reaches all 64.
SHIFTS = (52, 40, 28, 16, 4, 0)


def numbered(sizes: DataFrame) -> DataFrame:
    """sizes (source, ...) -> + n: its place from 0 by code points, null last.  Sorted over range
    partitions; what is added up over all of them is one count for each."""
    dealt = sizes.repartitionByRange(F.col("source").isNull(), "source").sortWithinPartitions(F.col("source").isNull(), "source")
    dealt = cut(dealt.withColumn("at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = cut(dealt.groupBy(part.alias("p")).agg(F.count("*").alias("rows")))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = counts.select("p", before.alias("before"))  # one row for each partition
    out = cut(dealt.join(F.broadcast(before), part == F.col("p")).select(*sizes.columns, (F.col("before") + inside).alias("n")))
    drop(dealt, counts)
    return out


def targets(sizes: DataFrame, weights: tuple[int, ...], cap: float) -> DataFrame:
    """(source, source_size) -> + target: weights by code-point order of source, nulls last, repeating;
    shares of the total stop at cap times the source's size and the excess is shared again by weight.

    That resharing has one fixed point, min(cap * size, level * weight).  The level rises as sources are
    found to be capped, and each step is one sum over the sources; it ends when no further one is.
    """
    t = numbered(sizes).withColumns({"w": F.get(F.array(*[F.lit(float(x)) for x in weights]), (F.col("n") % len(weights)).cast("int")), "cap": F.lit(float(cap)) * F.col("source_size")})
    total = t.agg(F.sum("source_size").cast("double")).first()[0] or 0.0
    level, capped = 0.0, -1
    while True:
        x = t.agg(*(F.coalesce(f, F.lit(0)) for c in [F.col("cap") <= level * F.col("w")] for f in (F.count_if(c), F.sum(F.when(c, F.col("cap"))), F.sum(F.when(~c, F.col("w")))))).first()
        if x[0] == capped or not x[2]:
            break
        level, capped = max(level, (total - x[1]) / x[2]), x[0]
    return t.select("source", "source_size", (F.least("cap", F.lit(level) * F.col("w")) if x[2] else F.col("cap")).alias("target"))


def repeats() -> Column:
    """How often a row is taken, by its h and the line of its source."""
    under = F.expr("shiftright(h, shift) < prefix or (shiftright(h, shift) = prefix and last)")
    return F.col("whole") + F.when(under, 1).otherwise(0)


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """docs (doc_id, text, source, ...) -> doc_id, source, size, source_size, target, repeats, taken.

    A document is taken floor(target / source_size) times, and once more if its hash lies under its
    source's threshold.  The threshold comes from histograms of words by (source, hash bucket): the
    bucket in which the running sum passes the rest of the budget is the only one refined, bucket
    by bucket, until it holds a single hash value; that value is taken if this ends nearer the target.
    Nothing is sorted and no source's rows are gathered, so a hot source costs no more than others.

    The hash covers doc_id and text, so reruns agree; rows equal in both stand or fall together.
    Null text: size 0.  Null source: a source of its own, last in order.  Sources without words:
    target 0.  No documents: no rows.  Other columns of docs are ignored.
    """
    base, lines, n_sources = thresholds(docs, weights, cap)
    out = base.join(small(lines, n_sources), base.source.eqNullSafe(F.col("s"))).withColumn("repeats", repeats())
    return out.select("doc_id", "source", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """docs (doc_id, text, source, ...) -> the same columns, each row as often as mix() takes it.

    The lines of the sources meet the rows themselves, so no text is shuffled while the sources are few
    enough to be broadcast.  See mix() for nulls, repeats, ties and empty tables."""
    base, lines, n_sources = thresholds(docs, weights, cap)
    drop(base)
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col("source").alias("of"), F.xxhash64("doc_id", "text").alias("h"))
    rows = rows.join(small(lines, n_sources), F.col("of").eqNullSafe(F.col("s"))).withColumn("n", repeats().cast("int")).where("n > 0")
    return rows.select("doc", F.explode(F.sequence(F.lit(1), F.col("n")))).select("doc.*")


def thresholds(docs: DataFrame, weights: tuple[int, ...], cap: int) -> tuple[DataFrame, DataFrame, int]:
    """(a table of rows: doc_id, source, size, h; a table of lines: one for each source s; their number)."""
    base = cut(docs.select(
        F.col("doc_id"), F.col("source"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64("doc_id", "text").alias("h"),
    ))
    goal = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    most = wave(docs.sparkSession)
    goal = cut(goal.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), most)
    n_sources = goal.count()

    edge = goal.where("rest > 0").select("source", "rest", F.lit(None).cast("int").alias("shift"), F.lit(None).cast("long").alias("prefix"), F.lit(True).alias("more"), F.lit(False).alias("last"))
    found = edge.where(F.lit(False))
    stale: list[DataFrame] = []
    for level, shift in enumerate(SHIFTS):
        now = small(edge.select(F.col("source").alias("s"), "rest", "prefix"), n_sources)
        hit = base.join(now, base.source.eqNullSafe(F.col("s")))
        if level:
            hit = hit.where(F.shiftright("h", SHIFTS[level - 1]) == F.col("prefix"))
        hist = hit.groupBy("source", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"), F.first("rest").alias("rest"))
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
        hist = hist.withColumn("upto", upto).where("upto >= rest and upto - n < rest")
        step = cut(hist.select("source", (F.col("rest") - (F.col("upto") - F.col("n"))).alias("rest"), F.lit(shift).alias("shift"), F.col("b").alias("prefix"),
                               (F.col("lo") != F.col("hi")).alias("more"), (2 * (F.col("rest") - (F.col("upto") - F.col("n"))) >= F.col("n")).alias("last")), most)
        stale.append(step)
        found = found.unionByName(step.where("not more"))
        edge = step.where("more")
        if edge.isEmpty():
            break
    found = cut(found, most)
    lines = cut(goal.join(found.select(F.col("source").alias("s"), "shift", "prefix", "last"), goal.source.eqNullSafe(F.col("s")), "left").drop("s", "rest").withColumnRenamed("source", "s"), most)
    drop(found, goal, *stale)
    return base, lines, n_sources
