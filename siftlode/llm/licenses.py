"""License scans by diagonal voting (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
K = 2

#: Phrases that must stand whole: (words, label).
BASE_PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)
#: Passages of public license texts and notices, found with gaps and changed words: (words, label).
PASSAGES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("the software is provided as is without warranty of any kind express or implied", "mit"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("licensed under cc by sa", "cc-by-sa"),
    ("gnu lesser general public license", "lgpl"),
)


def template_grams(spark: SparkSession, base: tuple, passages: tuple) -> DataFrame:
    """One row per k-gram of each template, and the row that every document's sentinel gram meets."""
    rows = [F.struct(F.lit(-1).alias("t"), F.lit(0).alias("tpos"), F.lit(0).alias("tlen"), F.lit(True).alias("exact"), F.lit("").alias("label"), F.lit("").alias("w1"), F.lit("").alias("w2"))]
    for t, (text, label) in enumerate((*base, *passages)):
        words = text.split(" ")
        rows += [F.struct(F.lit(t).alias("t"), F.lit(i).alias("tpos"), F.lit(len(words) - K + 1).alias("tlen"), F.lit(t < len(base)).alias("exact"), F.lit(label).alias("label"), F.lit(a).alias("w1"), F.lit(b).alias("w2"))
                 for i, (a, b) in enumerate(zip(words, words[1:], strict=False))]
    grams = spark.range(1).select(F.inline(F.array(*rows)))
    return grams.withColumn("gram", F.xxhash64("w1", "w2"))


def scan(docs: DataFrame, base: tuple = BASE_PHRASES, passages: tuple = PASSAGES, gap: int = 3, cover: float = 0.8) -> DataFrame:
    """docs (doc_id, text, ...) -> one row per found span: rid, doc_id, n_words, t, label, exact,
    start, end (words from 0, end exclusive), cover; and for each document a row with t = -1.

    All rolling word pairs meet the templates' pairs by hash in one broadcast join (the templates are
    a constant of the program), and the words themselves are compared so a collision cannot count.
    Hits are summed by diagonal, the place less the template's place; diagonals of a template at most
    `gap` apart in a document are merged, which lets words be dropped or put in; a merged span is
    verified by the share of distinct template pairs seen and by its length; where it is too long, as beside
    repeated pairs, each of its diagonals is verified by itself.  Phrases of `base` must
    be whole on one diagonal.  Rows are told apart by rid, so null and repeated doc_ids are scanned
    row by row.  Null or empty text: no words, no spans.  Other columns are ignored.
    """
    spark = docs.sparkSession
    words = docs.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id",
        F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0)).alias("words"),
    )
    at = words.select("rid", "doc_id", F.size("words").alias("n_words"), "words", F.explode(F.sequence(F.lit(-1), F.greatest(F.size("words") - K, F.lit(-1)))).alias("pos"))
    inside = F.col("pos") >= 0
    a = F.when(inside, F.get("words", F.col("pos"))).otherwise(F.lit(""))
    b = F.when(inside, F.get("words", F.col("pos") + 1)).otherwise(F.lit(""))
    at = at.select("rid", "doc_id", "n_words", "pos", a.alias("a"), b.alias("b"))
    at = at.withColumn("gram", F.xxhash64("a", "b"))
    hits = at.join(F.broadcast(template_grams(spark, base, passages)), "gram").where("a = w1 and b = w2")
    votes = hits.groupBy("rid", "doc_id", "n_words", "t", "exact", "tlen", "label", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.array_sort(F.collect_list("tpos")).alias("seen"))
    votes = votes.where("not exact or t < 0 or size(seen) = tlen")
    w = Window.partitionBy("rid", "t").orderBy("diagonal")
    new = F.col("exact") | (F.col("diagonal") - F.lag("diagonal", 1, -(1 << 30)).over(w) > gap)
    spans = votes.withColumn("new", F.when(new, 1).otherwise(0)).withColumn("span", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first, last = F.col("diagonal") + F.element_at("seen", 1), F.col("diagonal") + F.element_at("seen", -1) + K
    alone = F.size(F.array_distinct("seen")) / F.col("tlen")
    spans = spans.groupBy("rid", "doc_id", "n_words", "t", "exact", "tlen", "label", "span").agg(
        F.min(first).alias("start"), F.max(last).alias("end"), F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("pairs"),
        F.collect_list(F.when((F.col("tlen") > 0) & (alone >= cover), F.struct(first.alias("start"), last.alias("end"), alone.alias("cover")))).alias("whole"),
    )
    covered = F.when(F.col("tlen") > 0, F.col("pairs") / F.col("tlen")).otherwise(0.0)
    good = (F.col("t") < 0) | F.col("exact") | ((covered >= cover) & (F.col("end") - F.col("start") <= 2 * (F.col("tlen") + K)))
    # a chain of diagonals that has grown too long is told by those of them that stand alone
    kept = F.when(good, F.array(F.struct("start", "end", covered.alias("cover")))).otherwise(F.col("whole"))
    return spans.select("rid", "doc_id", "n_words", "t", "label", "exact", F.inline(kept))


def license_report(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: the spans of scan() summed up; see there for the edge cases."""
    spans = scan(docs, **options)
    base = F.col("exact") & (F.col("t") >= 0)
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    return spans.groupBy("rid").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").cast("long").alias("n_words"),
        F.sum(F.when(base, 1).otherwise(0)).cast("long").alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("t") >= 0).alias("labels"),
        F.max("cover").alias("score"),
    ).drop("rid")
