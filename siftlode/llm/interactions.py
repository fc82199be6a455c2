"""Filter interaction audit: what each order of a few filters keeps, removes and loses, from one CUBE of their flags.

A document that none of the filters of a set S fails survives S in whatever order S is applied.  So the 2^n
survivor counts of the sets tell every step of all n! orders: a step that applies f after the set S removes
survivors(S) - survivors(S + f).
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlode.llm.common import cut, wave

WORD = r"[^\x20\x09-\x0D]+"
#: Filters of one audit at most: 6 have 720 orders and 64 sets a part.
MOST_FILTERS = 6
COUNTS = ("docs", "good", "toxic")


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, text -> doc_id, part, A, B, C, D, E: the five audited failures of every whole text.

    A fewer than 200 words; B fewer than half of the words distinct; C more than 3 % of the code points in
    A-Z; D holds one of # $ % & * |; E equal to the text of a smaller doc_id.  A null text is empty (A fails,
    the others do not, E as the texts say); a null lang is the part ''.  A null doc_id is neither smaller nor
    larger than another, so E is false there; rows equal in id and text are treated alike.  Other columns are
    ignored.  Texts are compared by SHA-256, so only digests and ids are shuffled; the least id of a text is
    combined before its shuffle and comes back by an equi-join whose hot texts the planner can split."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_extract_all("t", F.lit(WORD), F.lit(0))
    base = docs.select(F.col("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("part"), text.alias("t"))
    flagged = base.select(
        "doc_id", "part", F.sha2(F.col("t").cast("binary"), 256).alias("digest"), words.alias("w"),
        (F.length(F.regexp_replace("t", "[^A-Z]+", "")) * 100 > F.length("t") * 3).alias("C"), F.col("t").rlike(r"[#$%&*|]").alias("D"),
    ).select("doc_id", "part", "digest", F.struct(F.size("w").alias("n"), F.size(F.array_distinct("w")).alias("d")).alias("s"), "C", "D")
    rows = flagged.select("doc_id", "part", "digest", (F.col("s.n") < 200).alias("A"), (F.col("s.d") * 100 < F.col("s.n") * 50).alias("B"), "C", "D")
    # only texts of several ids are joined, so a text that stands once costs a row of sums and no more
    first = base.groupBy(F.sha2(F.col("t").cast("binary"), 256).alias("same")).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("same", "first")
    return rows.join(first, rows.digest == first.same, "left").select("doc_id", "part", "A", "B", "C", "D", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("E"))


def marked(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows + good, toxic (0 or 1): by the labels of their doc_id.  An id with several labels is good, or toxic,
    if one of them says so; unlabelled and null ids are neither."""
    known = labels.groupBy(F.col("doc_id").alias("of")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    out = rows.join(known, rows.doc_id == known.of, "left").drop("of")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})


def survivors(rows: DataFrame, filters: tuple[str, ...], part: str = "part") -> DataFrame:
    """rows of failure flags (boolean, null as false) -> part, mask, and docs, good, toxic that survive the set of
    filters in mask (bit i: filters[i]).

    One row for each part and set, zeros included.  The rows are summed to cells of equal flags first, at most
    2^n for a part, in a table that is written once; the CUBE runs over the cells."""
    flags = [F.coalesce(f, F.lit(False)).alias(f) for f in filters]
    cells = rows.select(F.col(part).alias("part"), *flags, "good", "toxic").groupBy("part", *filters).agg(F.count(F.lit(1)).alias("docs"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    cells = cut(cells, wave(rows.sparkSession))
    cube = cells.cube("part", *filters).agg(*[F.sum(c).alias(c) for c in COUNTS], F.grouping("part").alias("all_parts"), *[F.grouping(f).alias(f"g_{f}") for f in filters])
    clear = None  # every flag that the grouping set selects is false
    mask = F.lit(0)
    for i, f in enumerate(filters):
        free = (F.col(f"g_{f}") == 1) | ~F.col(f)
        clear = free if clear is None else clear & free
        mask = mask + F.when(F.col(f"g_{f}") == 0, 1 << i).otherwise(0)
    found = cube.where((F.col("all_parts") == 0) & clear).select("part", mask.alias("mask"), *COUNTS)
    every = found.where("mask = 0").select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))).alias("mask"))
    found = found.withColumnsRenamed({"part": "fp", "mask": "fm"})
    return every.join(found, every.part.eqNullSafe(found.fp) & (every["mask"] == found.fm), "left").select("part", "mask", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS])


def _orders(rows: DataFrame, filters: tuple[str, ...]) -> DataFrame:
    """filter_order, step, letter, before (mask of the filters applied earlier): a table of n! * n rows."""
    spark, bit, made = rows.sparkSession, {f: 1 << i for i, f in enumerate(filters)}, []
    for order in permutations(filters):
        for k, f in enumerate(order):
            made.append(("".join(order), k + 1, f, sum(bit[x] for x in order[:k])))
    return spark.createDataFrame(made, "filter_order string, step int, letter string, before int")


def audit(rows: DataFrame, filters: tuple[str, ...] = ("A", "B", "C", "D", "E"), part: str = "part") -> DataFrame:
    """rows with flags, good and toxic -> one row for each part, order of the filters and step.

    kept after the step, removed by it, redundant (fail its filter, removed earlier), unique_fails (fail its
    filter alone), good_lost and toxic_lost in it, shapley (removed by its filter, summed over all orders),
    kept_share (of the part).  A null part is a part of its own; no rows, no parts; ties and repeated rows
    count each.  The pairs of sets that differ by one filter meet by an equi-join; the orders, a constant of
    n! * n rows (n at most 6), are broadcast to them."""
    if not filters or len(filters) > MOST_FILTERS:
        raise ValueError(f"an audit takes 1 to {MOST_FILTERS} filters")
    n, every = len(filters), (1 << len(filters)) - 1
    s = survivors(rows, filters, part)
    added = F.explode(F.array(*[F.struct(F.lit(f).alias("letter"), F.lit(1 << i).alias("bit")) for i, f in enumerate(filters)]))
    pair = s.select("part", F.col("mask").alias("before"), *[F.col(c).alias(f"b_{c}") for c in COUNTS], added.alias("x")).where("before & x.bit = 0")
    pair = pair.select("part", "before", "b_docs", "b_good", "b_toxic", "x.letter", (F.col("before") + F.col("x.bit")).alias("after"))
    after = s.select(F.col("part").alias("p"), F.col("mask").alias("m"), *[F.col(c).alias(f"a_{c}") for c in COUNTS])
    pair = pair.join(after, pair.part.eqNullSafe(after.p) & (pair.after == after.m)).select("part", "letter", "before", "after", "a_docs", *[(F.col(f"b_{c}") - F.col(f"a_{c}")).alias(f"lost_{c}") for c in COUNTS])
    # an order that applies `letter` after the k filters of `before` is one of k! * (n - 1 - k)!
    times = F.element_at(F.array(*[F.lit(_factorial(k) * _factorial(n - 1 - k)) for k in range(n)]), F.bit_count("before") + 1)
    of = pair.groupBy(F.col("part").alias("fp"), F.col("letter").alias("fl")).agg(
        F.sum(F.col("lost_docs") * times).alias("shapley"), F.sum(F.when(F.col("before") == 0, F.col("lost_docs"))).alias("fails"),
        F.sum(F.when(F.col("after") == every, F.col("lost_docs"))).alias("unique_fails"), F.sum(F.when(F.col("before") == 0, F.col("lost_docs") + F.col("a_docs"))).alias("all_docs"),
    )
    told = pair.join(of, pair.part.eqNullSafe(of.fp) & (pair.letter == of.fl))
    orders = F.broadcast(_orders(rows, filters).withColumnsRenamed({"letter": "ol", "before": "ob"}))
    return told.join(orders, (told.letter == orders.ol) & (told.before == orders.ob)).select(
        "part", "filter_order", "step", "letter", F.col("a_docs").alias("kept"), F.col("lost_docs").alias("removed"), (F.col("fails") - F.col("lost_docs")).alias("redundant"), "unique_fails",
        F.col("lost_good").alias("good_lost"), F.col("lost_toxic").alias("toxic_lost"), "shapley", (F.col("a_docs") / F.col("all_docs")).alias("kept_share"),
    )


def _factorial(n: int) -> int:
    return 1 if n < 2 else n * _factorial(n - 1)
