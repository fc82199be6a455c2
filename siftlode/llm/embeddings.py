"""Embedding near-dedup by Euclidean p-stable hashing and exact cosine checks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlode.llm.common import components, cut, drop, files_for, hook, in_blocks, whole_runs

#: Members of a bucket that one task compares; larger buckets are dealt out by pairs of blocks.
BLOCK = 4096
TILE = 1024
#: Bits of a vector's sketch, the signs of as many further projections.
SKETCH = 128


def collision(distance: float, width: float) -> float:
    """Chance that one quantised Gaussian projection puts two points at this distance in one cell."""
    r = width / distance
    phi = 0.5 * (1 + math.erf(-r / math.sqrt(2)))
    return 1 - 2 * phi - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


@dataclass(frozen=True)
class Hashing:
    """`tables` tables of `depth` projections of width `width`, drawn from `seed`."""

    depth: int
    tables: int
    width: float = 2.0
    seed: int = 11

    @classmethod
    def planned(cls, n: int, threshold: float, recall: float = 0.98, width: float = 2.0) -> Hashing:
        """Depth so that a random pair of unit vectors meets by chance about twice per table in n
        vectors; tables so that a pair exactly at the threshold is found with chance `recall`."""
        near, far = collision(math.sqrt(2 - 2 * threshold), width), collision(math.sqrt(2), width)
        depth = max(4, math.ceil(math.log(max(n, 2) / 2) / -math.log(far)))
        return cls(depth, math.ceil(math.log(1 - recall) / math.log(1 - near**depth)), width)

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """Bucket numbers of normalised vectors: rows by tables."""
        rng = np.random.default_rng([self.seed, unit.shape[1]])
        g = rng.standard_normal((unit.shape[1], self.tables * self.depth))
        offset = rng.uniform(0, self.width, self.tables * self.depth)
        cells = np.floor((unit @ g + offset) / self.width).astype(np.int64).reshape(len(unit), self.tables, self.depth)
        out = np.full((len(unit), self.tables), unit.shape[1], np.uint64) + np.arange(self.tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for d in range(self.depth):
            out = (out ^ cells[:, :, d].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(32)
        return out.view(np.int64)

    def sketch(self, unit: np.ndarray) -> np.ndarray:
        """Signs of SKETCH projections of normalised vectors: rows by two words of 64 bits."""
        g = np.random.default_rng([self.seed, unit.shape[1], 1]).standard_normal((unit.shape[1], SKETCH))
        return np.packbits(unit @ g > 0, axis=1).view(np.int64)


def far(threshold: float, miss: float = 1e-9) -> int:
    """Bits in which the sketches of two vectors at the threshold differ at most, but for a chance of `miss`."""
    p = math.acos(threshold) / math.pi
    rest, k = 1.0, -1
    while rest > miss:
        k += 1
        rest -= math.comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k)
    return k


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows, in double precision, of a list column whose lists are all of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def _bucket_rows(how: Hashing):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                dims = b["embedding"].value_lengths().to_numpy()
                for d in np.unique(dims):
                    part = b.filter(pa.array(dims == d))
                    unit = _matrix(part["embedding"])
                    keys, sketch = how.keys(unit), how.sketch(unit)
                    for t in range(how.tables):
                        yield pa.RecordBatch.from_arrays([pa.array(keys[:, t]), pa.array(np.full(len(keys), t, np.int32)), part["id"], pa.array(sketch[:, 0]), pa.array(sketch[:, 1])], ["bucket", "t", "id", "s1", "s2"])

    return run


def _near(most: int):
    """Sorted rows of buckets -> those whose sketch is near that of another row of their bucket."""

    def keep(rows: pa.Table) -> pa.RecordBatch:
        bucket, part = rows["bucket"].to_numpy(), rows["part"].to_numpy()
        run = np.cumsum(np.r_[0, (np.diff(bucket) != 0) | (np.diff(part) != 0)])
        a, b = rows["s1"].to_numpy().view(np.uint64), rows["s2"].to_numpy().view(np.uint64)
        block, two = rows["block"].to_numpy(), rows["two"].to_numpy()
        good = np.zeros(len(run), bool)
        at, step = np.flatnonzero(run[1:] == run[:-1]), 1
        while len(at):  # every pair of a run, whose size is bounded, without a matrix of them
            other = at + step
            hit = np.bitwise_count(a[at] ^ a[other]) + np.bitwise_count(b[at] ^ b[other]) <= most
            hit &= ~two[at] | (block[at] != block[other])
            good[at[hit]] = True
            good[other[hit]] = True
            step += 1
            at = at[at + step < len(run)]
            at = at[run[at + step] == run[at]]
        one = rows.combine_chunks().filter(pa.array(good))
        names = ["bucket", "part", "two", "block", "t", "id"]
        return pa.RecordBatch.from_arrays([pa.array(one[c].to_numpy()) for c in names], names)

    return lambda batches: map(keep, whole_runs(batches, ("bucket", "part")))


def _compare(how: Hashing, threshold: float):
    """Sorted rows of buckets -> links (kind 0: a, b) that span what is connected, and (kind 1: a, n)
    the vectors that a is linked to.  A pair counts only in the first table in which it meets."""

    def emit(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket, part = rows["bucket"].to_numpy(), rows["part"].to_numpy()
        first = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])])
        last = np.r_[first[1:], len(bucket)]
        several = last - first > 1
        if not several.any():
            return
        ids, copies = rows["id"].to_numpy(), rows["copies"].to_numpy()
        table, block, two = rows["t"].to_numpy(), rows["block"].to_numpy(), rows["two"].to_numpy()
        vectors = rows["embedding"].combine_chunks()
        lab, n = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        for lo, hi in zip(first[several].tolist(), last[several].tolist(), strict=True):
            v = _matrix(vectors.slice(lo, hi - lo))
            across = two[lo]  # pairs within a block belong to another part
            for i in range(0, hi - lo, TILE):
                for j in range(i, hi - lo, TILE):
                    x, y = np.nonzero(v[i : i + TILE] @ v[j : j + TILE].T >= threshold)
                    x, y = x + i, y + j
                    keep = x < y
                    if across:
                        keep &= block[lo + x] != block[lo + y]
                    x, y = x[keep], y[keep]
                    for at in range(0, len(x), 65536):  # bounded memory for dense buckets
                        a, b = x[at : at + 65536], y[at : at + 65536]
                        used, where = np.unique(np.r_[a, b], return_inverse=True)
                        k = how.keys(v[used])
                        same = k[where[: len(a)]] == k[where[len(a) :]]
                        new = same.argmax(axis=1) == table[lo + a]
                        a, b = lo + a[new], lo + b[new]
                        np.add.at(n, a, copies[b])
                        np.add.at(n, b, copies[a])
                        lab = hook(lab, a, b)
        a = np.flatnonzero(lab != np.arange(len(ids)))
        c = np.flatnonzero(n)
        kind = np.r_[np.zeros(len(a), np.int32), np.ones(len(c), np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.r_[ids[a], ids[c]]), pa.array(np.r_[ids[lab[a]], n[c]])], ["kind", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(batches, ("bucket", "part")):
            yield from emit(rows)

    return run


def link_vectors(classes: DataFrame, threshold: float, how: Hashing, block: int = BLOCK) -> DataFrame:
    """Distinct valid vectors (id, copies, embedding) -> a table (kind, a, b): see _compare().

    Buckets are formed of ids and sketches, 36 bytes a row; vectors are fetched only for rows that have
    a near sketch in their bucket, which chance meetings do not."""
    rows = classes.select("id", "embedding").mapInArrow(_bucket_rows(how), "bucket long, t int, id long, s1 long, s2 long")
    table = cut(rows)
    dealt = in_blocks(table, "bucket", "id", block, files_for(table)).repartition("bucket", "part").sortWithinPartitions("bucket", "part")
    live = dealt.select("bucket", "part", "two", "block", "t", "id", "s1", "s2").mapInArrow(_near(far(threshold)), "bucket long, part int, two boolean, block int, t int, id long")
    live = cut(live, files_for(table))
    drop(table)
    vectors = classes.select(F.col("id").alias("vid"), "copies", "embedding")
    both = live.join(vectors, F.col("id") == F.col("vid")).repartition("bucket", "part").sortWithinPartitions("bucket", "part", "block", "id")
    found = both.select("bucket", "part", "two", "block", "t", "id", "copies", "embedding").mapInArrow(_compare(how, threshold), "kind int, a long, b long")
    found = cut(found, files_for(live))
    drop(live)
    return found


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.98, how: Hashing | None = None) -> DataFrame:
    """vectors (vec_id, embedding array<float>, ...) -> vec_id, n_links, component_id, kept, one row per row.

    embedding: an array of floats or doubles, compared as they are.  Normalised vectors are hashed by
    quantised Gaussian projections into several tables; those that share a bucket in any are compared by cosine in double precision, and pairs at or above the
    threshold are links.  Equal vectors are one class that is compared once and counts as many links as
    it has copies.  n_links: other rows linked directly.  component_id: smallest vec_id reachable.

    Null, zero, empty vectors and those with null or non-finite parts link with nothing, not even with
    their copies; vectors of different lengths never link.  Null vec_ids take part in links; their own
    component_id is the component's smallest non-null id.  An empty table gives no rows.
    """
    e = F.col("embedding")
    good = F.coalesce(e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(good, e).alias("embedding"))
    classes = rows.where("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()), files_for(vectors))
    how = how or Hashing.planned(classes.count(), threshold, recall)
    found = link_vectors(classes, threshold, how)
    degree = found.where("kind = 1").groupBy(F.col("a").alias("did")).agg(F.sum("b").alias("others"))
    comp = components(found.where("kind = 0").select("a", "b"))
    named = classes.join(comp.withColumnRenamed("id", "cid"), classes.id == F.col("cid"), "left").join(degree, classes.id == F.col("did"), "left")
    named = cut(named.select("embedding", "first_id", F.coalesce("component", "id").alias("component"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), files_for(classes))
    roots = named.groupBy(F.col("component").alias("root")).agg(F.min("first_id").alias("component_id"))
    named = named.join(roots, named.component == roots.root).select(F.col("embedding").alias("e"), "n_links", "component_id")
    out = rows.join(named, rows.embedding == named.e, "left").coalesce(files_for(classes))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
