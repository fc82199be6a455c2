"""SimHash near-dedup with pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlode.llm.bloom import may_be_in
from siftlode.llm.common import components, cut, drop, files_for, hook, in_blocks, whole_runs

SEGMENTS, WIDTH = 4, 16
#: Members of a bucket that one task compares; larger buckets are dealt out by pairs of blocks.
BLOCK = 100_000
#: Runs longer than this are split again by what is left of the fingerprint.
RUN = 128
#: Shingles hashed at once, so that memory does not follow a text's length.
CHUNK = 1 << 18


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64 bits: bit i is set if more than half of the shingles' XXH64 values, repeats included, have it."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        part = w[at : min(at + CHUNK, n) + words - 1]
        h = np.array([digest(b" ".join(s), seed) for s in zip(*(part[i:] for i in range(words)), strict=False)] if len(part) >= words else [digest(b" ".join(part), seed)], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for i in range(0, len(bits), 255):  # sums of at most 255 rows fit a byte
            ones += bits[i : i + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs (text, long columns named in keep, ...) -> those columns and fp, the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), words, seed) for t in b.column(len(keep))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(fp.view(np.int64))], [*keep, "fp"])

    return docs.select(*[F.col(c).cast("long").alias(c) for c in keep], "text").mapInArrow(run, ", ".join(f"`{c}` long" for c in keep) + ", fp long")


def ring_keys(tau: int = 3) -> list[tuple[int, list[int]]]:
    """For each start of the ring: (start, masks of exact agreement) that its first two chain budgets imply.

    Over m = 4 segments a pair within tau = 3 has a start whose chain of l segments differs in at most
    l * tau / m bits, for every l: none in the first segment, one in the first two, two in the first
    three.  So the first segment agrees and of the second at least one half does.
    """
    if not 0 <= tau < SEGMENTS:
        raise ValueError("the ring of 4 segments serves distances of 0 to 3")
    seg = [((1 << WIDTH) - 1) << (WIDTH * i) for i in range(SEGMENTS)]
    half = (1 << (WIDTH // 2)) - 1
    return [(i, [seg[i] | half << (WIDTH * j), seg[i] | half << (WIDTH * j + WIDTH // 2)]) for i in range(SEGMENTS) for j in [(i + 1) % SEGMENTS]]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _chain_masks(start: int, tau: int) -> list[tuple[np.uint64, int]]:
    out, mask = [], 0
    for length in range(1, SEGMENTS + 1):
        mask |= ((1 << WIDTH) - 1) << (WIDTH * ((start + length - 1) % SEGMENTS))
        out.append((np.uint64(mask), length * tau // SEGMENTS))
    return out


def _connected(fp: np.ndarray, run: np.ndarray, start: np.ndarray, tau: int, refine: bool = True) -> np.ndarray:
    """Labels of fp (sorted by run) under the links between places of equal run whose chains and full
    distance stay in budget.  Pairs already connected are not compared again and links are joined as they
    are found, so neither work nor memory follows the number of pairs of a dense run."""
    lab = np.arange(len(fp))
    if len(fp) < 2:
        return lab
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    length = np.diff(np.r_[first, len(run)])
    short = np.ones(len(fp), bool)
    if refine:
        short = np.repeat(length <= RUN, length)
        for f, n in zip(first[length > RUN].tolist(), length[length > RUN].tolist(), strict=True):
            # three differing bits cannot touch all four sets of every fourth bit: one of them agrees,
            # so the run falls into four times as many smaller ones
            x = fp[f : f + n]
            for q in range(4):
                part = x & np.uint64(0x1111111111111111 << q)
                order = np.argsort(part, kind="stable")
                sub = _connected(x[order], part[order], np.full(n, start[f]), tau, refine=False)
                lab = hook(lab, f + order, f + order[sub])
    chains = [_chain_masks(s, tau) for s in range(SEGMENTS)]
    masks = [np.array([c[level][0] for c in chains], np.uint64) for level in range(SEGMENTS)]
    budgets = [chains[0][level][1] for level in range(SEGMENTS)]
    at = np.flatnonzero(short[:-1] & (run[1:] == run[:-1]))
    step = 1
    while len(at):
        i = at[lab[at] != lab[at + step]]
        for level in range(1, SEGMENTS):
            i = i[np.bitwise_count((fp[i] ^ fp[i + step]) & masks[level][start[i]]) <= budgets[level]]
        lab = hook(lab, i, i + step)
        if step % 16 == 0:  # runs that are one set by now are done
            whole = np.repeat(np.minimum.reduceat(lab, first) == np.maximum.reduceat(lab, first), length)
            at = at[~whole[at]]
        step += 1
        at = at[at + step < len(fp)]
        at = at[run[at + step] == run[at]]
    return lab


def _compare(tau: int):
    """Sorted rows (bucket, part, start, fp) -> links (a, b) that span each bucket's connected sets."""

    def emit(rows: pa.Table) -> pa.RecordBatch:
        fp = rows["fp"].to_numpy().view(np.uint64)
        bucket, part = rows["bucket"].to_numpy(), rows["part"].to_numpy()
        run = np.cumsum(np.r_[0, (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])]) if len(fp) else bucket
        lab = _connected(fp, run, rows["start"].to_numpy(), tau)
        moved = np.flatnonzero(lab != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[moved].view(np.int64)), pa.array(fp[lab[moved]].view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(emit, whole_runs(batches, ("bucket", "part")))

    return run


def fingerprint_links(fps: DataFrame, tau: int = 3, block: int = BLOCK) -> DataFrame:
    """Distinct fingerprints (fp long) -> links (a, b) between fingerprints within tau bits; they
    connect whatever is connected, without listing all pairs of a dense set.

    Each fingerprint goes to eight buckets, by ring start and half of the second segment.  A bucket of
    more than `block` members is cut into blocks by hash and every pair of blocks is compared by itself.
    """
    keys = [F.struct(F.lit(start).alias("start"), F.xxhash64(F.lit(start), F.lit(n), F.col("fp").bitwiseAND(F.lit(_signed(mask)))).alias("bucket"))
            for start, masks in ring_keys(tau) for n, mask in enumerate(masks)]
    rows = fps.select("fp", F.inline(F.array(*keys)))
    rows = in_blocks(rows, "bucket", "fp", block, files_for(fps))
    dealt = rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "fp")
    return dealt.select("bucket", "part", "start", "fp").mapInArrow(_compare(tau), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, tau: int = 3, seed: int = 42) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, fingerprint (16 hex digits), component_id, one row per row.

    component_id is the smallest doc_id reachable by links of at most tau differing bits, itself
    included.  Equal fingerprints are one vertex, so copies are never paired with each other.
    Null or empty text: fingerprint zero, linked like any other.  Texts of fewer words than a shingle
    have their whole sequence as one.  A row with null doc_id takes part by its text and gets the
    component's smallest doc_id (null if there is none); repeated rows give repeated results; an empty
    table gives no rows; other columns are ignored.
    """
    prints = cut(fingerprints(docs, words, seed))
    most = files_for(prints)
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), most)
    edges = cut(fingerprint_links(classes.select("fp"), tau), most)
    comp = components(edges)
    linked = classes.join(comp, classes.fp == comp.id, "left").select("fp", "first_doc", F.coalesce("component", "fp").alias("component"))
    linked = cut(linked, most)
    drop(classes, edges)
    roots = linked.groupBy(F.col("component").alias("root")).agg(F.min("first_doc").alias("component_id"))
    named = linked.join(roots, linked.component == roots.root).select(F.col("fp").alias("class_fp"), "component_id")
    out = prints.join(named, prints.fp == named.class_fp)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id").coalesce(most)


def row_key() -> dict[str, Column]:
    """What tells rows apart: the id, null ones last, and a hash of the row."""
    return {"did": F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), "row": F.xxhash64("doc_id", "text")}


def first_rows(docs: DataFrame, prints: DataFrame, comp: DataFrame) -> DataFrame:
    """The row of docs that comes first in each component; prints (did, row: row_key(), fp).

    Only rows that go, or stand several times, are looked for by a join, and texts that a Bloom filter
    shows not to be among them are not shuffled."""
    most = files_for(prints)
    rows = prints.groupBy("did", "row").agg(F.first("fp").alias("fp"), F.count("*").alias("n"))
    rows = cut(rows.join(comp, rows.fp == comp.id, "left").select("did", "row", "n", F.coalesce("component", "fp").alias("c")), most)
    best = rows.groupBy(F.col("c").alias("bc")).agg(F.min(F.struct("did", "row")).alias("first"))
    fates = rows.join(best, rows.c == best.bc).select(F.col("did").alias("fd"), F.col("row").alias("fr"), (F.struct("did", "row") == F.col("first")).alias("stays"), "n")
    fates = cut(fates.where("not stays or n > 1"), most)
    drop(rows)
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "text").withColumns(row_key()).drop("doc_id", "text")
    maybe = may_be_in(fates.select(F.col("fr").alias("key")), F.col("row"))
    some = keyed if maybe is None else keyed.where(maybe)
    some = some.join(fates, (F.col("did") == F.col("fd")) & (F.col("row") == F.col("fr")), "left")
    out = some.where("n is null").select("doc.*").unionByName(some.where("stays").dropDuplicates(["did", "row"]).select("doc.*"))
    return out if maybe is None else out.unionByName(keyed.where(~maybe).select("doc.*"))


def keep_first(docs: DataFrame, words: int = 3, tau: int = 3, seed: int = 42) -> DataFrame:
    """docs (doc_id, text, ...) -> the same columns, one row of each component of near_duplicates().

    The row of the smallest doc_id stays (null ids come last; of rows with one id, the least hash of
    the text; of rows equal in both, any one).  An empty table gives no rows.
    """
    prints = cut(fingerprints(docs.select("doc_id", "text").withColumns(row_key()), words, seed, ("did", "row")))
    edges = cut(fingerprint_links(prints.select("fp").distinct(), tau), files_for(prints))
    out = first_rows(docs, prints, components(edges))
    drop(prints, edges)
    return out
