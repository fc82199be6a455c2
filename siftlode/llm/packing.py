"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlode.llm.common import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Pieces that are packed with each other; more pieces make more shards, not larger ones.
SHARD = 20_000


class Packer:
    """Bins in order of what is left in them, each with bitmaps of its sources and duplicate clusters.

    A source has `per_source` bits of a bin and may take no more; a cluster has one.
    """

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.slots = capacity, per_source
        self.left: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.by_left: dict[int, dict[int, None]] = defaultdict(dict)
        self.filled = 0  # bit r: some bin has r left
        self.full_for: dict[int, dict[int, int]] = defaultdict(lambda: defaultdict(int))  # source -> left -> bins it may not enter
        self.has: dict[int, dict[int, int]] = defaultdict(lambda: defaultdict(int))  # cluster -> left -> bins that hold it
        self.saturated: list[list[int]] = []
        self.held: list[list[int]] = []

    def _count(self, b: int, by: int) -> None:
        r = self.left[b]
        for s in self.saturated[b]:
            self.full_for[s][r] += by
        for c in self.held[b]:
            self.has[c][r] += by

    def place(self, size: int, source: int, cluster: int) -> int:
        """The bin with the least room that suffices and no conflict; the successor search goes on over
        fuller room until there is one, else a new bin is opened.  cluster -1: has no duplicates."""
        full = ((1 << self.slots) - 1) << (source * self.slots)
        mark = 1 << cluster if cluster >= 0 else 0
        full_for, has = self.full_for.get(source, {}), self.has.get(cluster, {}) if mark else {}
        found, ahead, r = -1, self.filled >> size, size
        while ahead:
            step = (ahead & -ahead).bit_length() - 1
            r, ahead = r + step, ahead >> step
            bins = self.by_left[r]
            if len(bins) > full_for.get(r, 0) and len(bins) > has.get(r, 0):
                found = next((b for b in bins if self.sources[b] & full != full and not self.clusters[b] & mark), -1)
                if found >= 0:
                    break
            ahead &= ~1
        if found < 0:
            found = len(self.left)
            for x, v in ((self.left, self.capacity), (self.sources, 0), (self.clusters, 0), (self.saturated, []), (self.held, [])):
                x.append(v)
        else:
            self._count(found, -1)
            r = self.left[found]
            del self.by_left[r][found]
            if not self.by_left[r]:
                self.filled &= ~(1 << r)
        free = full & ~self.sources[found]
        self.sources[found] |= free & -free
        if self.sources[found] & full == full:
            self.saturated[found].append(source)
        if mark:
            self.clusters[found] |= mark
            self.held[found].append(cluster)
        self.left[found] -= size
        self.by_left[self.left[found]][found] = None
        self.filled |= 1 << self.left[found]
        self._count(found, 1)
        return found


def pack_sizes(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int, per_source: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of pieces given in order of falling size."""
    _, source = np.unique(sources, return_inverse=True)
    _, cluster, n = np.unique(clusters, return_inverse=True, return_counts=True)
    name = np.where(n > 1, np.cumsum(n > 1) - 1, -1)[cluster]
    packer = Packer(capacity, per_source)
    bins = np.fromiter((packer.place(*x) for x in zip(sizes.tolist(), source.tolist(), name.tolist(), strict=True)), np.int64, len(sizes))
    offset, used = np.zeros(len(sizes), np.int64), defaultdict(int)
    for i, (b, size) in enumerate(zip(bins.tolist(), sizes.tolist(), strict=True)):
        offset[i] = used[b]
        used[b] += size
    return bins, offset


def pieces(docs: DataFrame, capacity: int, cluster: Column | None) -> DataFrame:
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    text = F.xxhash64(F.lower(F.regexp_replace(F.trim(F.coalesce("text", F.lit(""))), r"\s+", " ")))
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("source").alias("source"), (text if cluster is None else F.xxhash64(cluster)).alias("cluster"), size.alias("size"))
    parts = F.greatest(F.ceil(F.col("size") / capacity), F.lit(1)).cast("int")
    cutup = one.select("doc_id", "source", "cluster", "size", F.explode(F.sequence(F.lit(0), parts - 1)).alias("piece"))
    start = F.col("piece").cast("long") * capacity
    return cutup.select("doc_id", "source", "cluster", "piece", start.alias("start_word"), F.least(F.col("size") - start, F.lit(capacity)).cast("long").alias("n_words"))


def pack(docs: DataFrame, capacity: int = 2048, per_source: int = 4, cluster: Column | None = None, shard: int = SHARD) -> DataFrame:
    """docs (doc_id, text, source, ...) -> bin_id, doc_id, piece, start_word, n_words, bin_offset, bin_words.

    Every word of every document is put into one bin; no bin holds more than `capacity` words, more than
    `per_source` pieces of one source, or two pieces of one duplicate cluster (`cluster`; by default
    texts equal but for case and white space).  Longer texts are cut into pieces of `capacity` words.
    Pieces are dealt by hash into shards of about `shard`, which spreads hot sources and clusters; in a
    shard they are placed largest first, each into the fullest bin that takes it.

    Null and empty texts are pieces of no words and are placed too; null sources are one source; null
    and repeated ids are pieces of their own.  Reruns give the same bins.  An empty table gives no rows.
    """
    rows = cut(pieces(docs, capacity, cluster))
    n = rows.count()
    shards = max(1, -(-n // shard))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "cluster"), F.lit(shards)))
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", F.desc("n_words"), "cluster", "doc_id", "piece", "source")
    schema = "bin_id long, doc_id long, piece int, start_word long, n_words long, bin_offset long, bin_words long"
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def emit(t: pa.Table) -> pa.RecordBatch:
        sizes = t["n_words"].to_numpy()
        bins, offset = pack_sizes(sizes, t["source"].to_numpy(), t["cluster"].to_numpy(), capacity, per_source)
        total = np.bincount(bins, sizes).astype(np.int64)[bins]
        ids = pa.array(t["shard"][0].as_py() * (1 << 32) + bins)
        one = t.combine_chunks()
        cols = [ids, *(one[c].combine_chunks() if isinstance(one[c], pa.ChunkedArray) else one[c] for c in ("doc_id", "piece", "start_word", "n_words")), pa.array(offset), pa.array(total)]
        return pa.RecordBatch.from_arrays(cols, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            s = b["shard"].to_numpy()
            cuts = [0, *(np.flatnonzero(s[1:] != s[:-1]) + 1).tolist(), len(s)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if held and held[-1]["shard"][-1].as_py() != s[lo]:
                    yield emit(pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(lo, hi - lo))
        if held:
            yield emit(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, schema)
