"""Near copies by their sets of 5-word shingles: MinHash bands give candidates, the words decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlode.llm import simhash
from siftlode.llm.bloom import may_be_in
from siftlode.llm.common import components, cut, drop, files_for, hook, in_blocks, whole_runs
from siftlode.llm.simhash import fingerprint
from siftlode.llm.suffixes import _mix, rolling, word_hashes

WORDS = 5
#: Sets whose Jaccard similarity is at least this (as a fraction) are near copies.
SIMILAR = (4, 5)
#: A pair at similarity 0.8 agrees in all rows of some band with chance 1 - (1 - 0.8^6)^32 = 0.99994.
BANDS, ROWS = 32, 6
#: Shingles put through all permutations at once, so that memory does not follow a text's length.
CHUNK = 512
#: Texts of a bucket that one task compares; more are dealt out by pairs of blocks.
BLOCK = 2048
#: Shingles of a block on average, so that a part of two blocks is bounded in bytes too: long texts count as several.
BLOCK_SHINGLES = 1 << 20
#: Shingles counted at once for all texts of a part.
COLUMNS = 4096

_rng = np.random.default_rng(11)
_ODD = _rng.integers(0, 1 << 31, (BANDS * ROWS, 1), np.uint32) << np.uint32(1) | np.uint32(1)
_MASK = _rng.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)
_ROW = _rng.integers(0, 1 << 63, (1, ROWS), np.uint64) << np.uint64(1) | np.uint64(1)
_BAND = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the different runs of five words (parts between ASCII white space, A-Z
    lower-cased); a shorter text is one, a text without words none."""
    h = word_hashes(text)
    return np.unique(rolling(h, min(WORDS, len(h)))) if len(h) else h


def similar(both: Column, na: Column, nb: Column) -> Column:
    return both * (SIMILAR[0] + SIMILAR[1]) >= (na + nb) * SIMILAR[0]


def bands(text: str | None) -> tuple[int, np.ndarray]:
    """(number of different shingles, one hash for each band); no bands for a text without words."""
    h = shingles(text)
    if not len(h):
        return 0, np.zeros(0, np.int64)
    # 32 bits are enough to order a text's shingles by chance; bands only make candidates
    low = (h ^ (h >> np.uint64(32))).astype(np.uint32)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(h), CHUNK):
        x = (low[at : at + CHUNK] ^ _MASK) * _ODD
        x ^= x >> np.uint32(15)
        x *= _ODD
        np.minimum(least, x.min(axis=1), out=least)
    least = least.astype(np.uint64)
    return len(h), _mix((_mix(least).reshape(BANDS, ROWS) * _ROW).sum(axis=1, dtype=np.uint64) ^ _BAND).view(np.int64)


def prints_and_bands(docs: DataFrame) -> DataFrame:
    """docs (did, row, th, text) -> did, row, th, the SimHash fingerprint fp, and bands() as n and buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, sizes, found = np.zeros(b.num_rows, np.uint64), [], []
            for i, text in enumerate(b["text"]):
                fp[i] = fingerprint(text.as_py())
                n, keys = bands(text.as_py())
                sizes.append(n)
                found.append(keys)
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))
            cols = [b["did"], b["row"], b["th"], pa.array(fp.view(np.int64)), pa.array(sizes, pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(cols, ["did", "row", "th", "fp", "n", "buckets"])

    return docs.select("did", "row", "th", "text").mapInArrow(run, "did long, row long, th long, fp long, n long, buckets array<long>")


def shingle_sets(docs: DataFrame, need: DataFrame) -> DataFrame:
    """docs (th, text), need (nh) -> a table (sh, shingles) of one row for each text that is needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t.as_py()).view(np.int64) for t in b["text"]]
            yield pa.RecordBatch.from_arrays([b["th"], pa.array(found, pa.list_(pa.int64()))], ["sh", "shingles"])

    maybe = may_be_in(need.select(F.col("nh").alias("key")), F.col("th"))
    texts = docs.select("th", "text")
    texts = (texts if maybe is None else texts.where(maybe)).join(need, F.col("th") == F.col("nh"))
    return cut(texts.groupBy("th").agg(F.first("text").alias("text")).mapInArrow(run, "sh long, shingles array<long>"), files_for(docs))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b: texts, fa, fb: fingerprints) -> a table fa, fb of those that are similar."""
    left, right = sets.select(F.col("sh").alias("ah"), F.col("shingles").alias("sa")), sets.select(F.col("sh").alias("bh"), F.col("shingles").alias("sb"))
    both = pairs.join(left, pairs.a == left.ah).join(right, pairs.b == right.bh)
    return cut(both.where(similar(F.size(F.array_intersect("sa", "sb")), F.size("sa"), F.size("sb"))).select("fa", "fb").distinct(), files_for(pairs))


def _several(run: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which rows (sorted by run) are of a run with more than one c."""
    if not len(run):
        return np.zeros(0, bool)
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    return np.repeat(np.minimum.reduceat(c, first) < np.maximum.reduceat(c, first), np.diff(np.r_[first, len(run)]))


def _links(t: pa.Table) -> pa.RecordBatch:
    """Whole parts of buckets (bucket, part, c, shingles) -> links (a, b) that connect the sets c of a part
    between which some texts are similar.

    Similar texts share four fifths of either's shingles, so a text with more that no other text of its
    part has is left out before the rest are compared, by products of 0-1 matrices."""
    bucket, part, c = (t[x].to_numpy() for x in ("bucket", "part", "c"))
    sets = t["shingles"].combine_chunks()
    n = sets.value_lengths().to_numpy().astype(np.int64)
    flat = sets.flatten().to_numpy()
    run = np.cumsum(np.r_[0, (np.diff(bucket) != 0) | (np.diff(part) != 0)])
    row = np.repeat(np.arange(len(n)), n)
    keep = np.ones(len(n), bool)
    for _ in range(2):
        keep &= np.isin(np.arange(len(n)), np.flatnonzero(keep)[_several(run[keep], c[keep])])
        some = np.flatnonzero(keep[row])
        order = some[np.lexsort((flat[some], run[row[some]]))]
        new = np.r_[True, (flat[order][1:] != flat[order][:-1]) | (run[row[order]][1:] != run[row[order]][:-1])] if len(order) else np.zeros(0, bool)
        code = np.cumsum(new) - 1
        held = np.bincount(code)[code] > 1 if len(order) else new
        order, code = order[held], code[held]
        keep &= np.bincount(row[order], minlength=len(n)) * SIMILAR[1] >= n * SIMILAR[0]
    keep &= np.isin(np.arange(len(n)), np.flatnonzero(keep)[_several(run[keep], c[keep])])
    stay = keep[row[order]]
    order, code = order[stay], code[stay]
    by_run = np.argsort(run[row[order]], kind="stable")
    order, code = order[by_run], code[by_run]
    of = run[row[order]]
    out: list[tuple[np.ndarray, np.ndarray]] = []
    edges = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True]) if len(of) else of
    for lo, hi in zip(edges, edges[1:], strict=False):
        rows, at = np.unique(row[order[lo:hi]], return_inverse=True)
        names, col = np.unique(code[lo:hi], return_inverse=True)
        common = np.zeros((len(rows), len(rows)), np.float32)
        for begin in range(0, len(names), COLUMNS):
            inside = (col >= begin) & (col < begin + COLUMNS)
            has = np.zeros((len(rows), min(COLUMNS, len(names) - begin)), np.float32)
            has[at[inside], col[inside] - begin] = 1
            common += has @ has.T
        kinds, lab = np.unique(c[rows], return_inverse=True)
        size = n[rows]
        i, j = np.nonzero(np.triu(common * (SIMILAR[0] + SIMILAR[1]) >= (size[:, None] + size) * SIMILAR[0], 1))
        joined_ = hook(np.arange(len(kinds)), lab[i], lab[j])
        moved = np.flatnonzero(joined_ != np.arange(len(kinds)))
        out.append((kinds[moved], kinds[joined_[moved]]))
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*out, strict=True) if out else ((), ())))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return map(_links, whole_runs(batches, ("bucket", "part")))


def joined(texts: DataFrame, docs: DataFrame, links: DataFrame, block: int = BLOCK) -> DataFrame:
    """texts (th, fp, n, buckets), docs (th, text) and links (a, b) between fingerprints -> a table (id,
    component) of all fingerprints that `links` or similar texts connect with another.

    Texts of one fingerprint count as linked, so a pair of similar texts is a link of their fingerprints.
    In each bucket all texts are first compared with one, that which shares most buckets with others:
    where copies were made of one text, it is that one or near to it.  Then the texts of a bucket which
    is still of several components are compared with each other inside tasks, so neither step lists
    the pairs of a dense group.
    """
    most = files_for(texts)
    rows = texts.select("th", "fp", "n", F.explode("buckets").alias("bucket"))
    of_two = cut(rows.groupBy(F.col("bucket").alias("tb")).agg(F.min("th").alias("lo"), F.max("th").alias("hi")).where("lo < hi").select("tb"), most)
    maybe = may_be_in(of_two.select(F.col("tb").alias("key")), F.col("bucket"))
    shared = (rows if maybe is None else rows.where(maybe)).join(of_two, F.col("bucket") == F.col("tb")).groupBy("bucket", "th").agg(F.first("fp").alias("fp"), F.first("n").alias("n"))
    shared = cut(shared, most)
    sizes = shared.groupBy(F.col("bucket").alias("sb")).agg(F.count("*").alias("size"))
    known = shared.join(sizes, F.col("bucket") == F.col("sb")).groupBy(F.col("th").alias("kh")).agg(F.sum("size").alias("met"))
    sets = shingle_sets(docs, known.select(F.col("kh").alias("nh")))
    met = cut(shared.join(known, F.col("th") == F.col("kh")).select("bucket", "th", "fp", "n", "met"), most)
    drop(shared, of_two)
    centre = met.groupBy(F.col("bucket").alias("cb")).agg(F.max(F.struct("met", "th", "fp", "n")).alias("m"))
    # what is within 3 bits is linked already
    pairs = met.join(centre, F.col("bucket") == F.col("cb")).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("m.fp"))) > 3).where(F.least("n", "m.n") * SIMILAR[1] >= F.greatest("n", "m.n") * SIMILAR[0])
    pairs = cut(pairs.select(F.col("th").alias("a"), F.col("m.th").alias("b"), F.col("fp").alias("fa"), F.col("m.fp").alias("fb")).distinct(), most)
    found = verified(pairs, sets)
    comp = cut(components(links.select("a", "b").unionByName(found.select(F.col("fa").alias("a"), F.col("fb").alias("b")))), most)
    now = cut(met.join(comp, F.col("fp") == F.col("id"), "left").select("bucket", "th", "n", F.coalesce("component", "fp").alias("c")), most)
    drop(met, pairs, found)
    # two texts of a bucket have been compared; of more, only the centre has been with each
    open_ = now.groupBy(F.col("bucket").alias("ob")).agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")).where("lo < hi and size > 2").select("ob")
    rest = cut(now.join(open_, F.col("bucket") == F.col("ob")).select("bucket", "th", "n", "c"), most)
    drop(now)
    size = F.greatest(F.lit(1.0), F.col("n") * (block / BLOCK_SHINGLES))
    rest_in = in_blocks(rest, "bucket", "th", block, most, size).join(sets, F.col("th") == F.col("sh")).select("bucket", "part", "c", "shingles")
    more = cut(rest_in.repartition("bucket", "part").sortWithinPartitions("bucket", "part").mapInArrow(_compare, "a long, b long").distinct(), most)
    drop(rest, sets)
    last = components(more).select(F.col("id").alias("was"), F.col("component").alias("to"))
    # a fingerprint that only the last links reach is its own component before them
    all_ = comp.unionByName(last.join(comp, last.was == comp.id, "left_anti").select(F.col("was").alias("id"), F.col("was").alias("component")))
    out = cut(all_.join(last, F.col("component") == F.col("was"), "left").select("id", F.coalesce("to", "component").alias("component")), most)
    drop(more, comp)
    return out


def keep_first(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> the same columns, one row of each set of connected near copies.

    Two texts are linked if their sets of 5-word shingles have a Jaccard similarity of 0.8 or more, or
    by the rule of simhash.near_duplicates(): fingerprints of 3-word shingles at most 3 bits apart.
    Which row stays, and empty tables: as in simhash.keep_first().
    """
    keyed = docs.select("doc_id", "text").withColumns(simhash.row_key() | {"th": F.xxhash64("text")})
    prints = cut(prints_and_bands(keyed))
    edges = cut(simhash.fingerprint_links(prints.select("fp").distinct()), files_for(prints))
    comp = joined(prints, keyed, edges)
    out = simhash.first_rows(docs, prints, comp)
    drop(prints, edges, comp)
    return out
