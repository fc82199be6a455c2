"""Suffix-array dedup over sparse suffixes: repeated passages across documents, found and cut."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlode.llm.bloom import may_be_in
from siftlode.llm.common import cut, drop, files_for, small, whole_runs

#: A passage repeats if this many words in a row do.
MIN_WORDS = 50
#: Words of a minimiser's gram; a passage has WINDOW of them, and the suffix at the least is retained.
GRAM = 8
WINDOW = MIN_WORDS - GRAM + 1
#: Words from a retained position that lie inside any passage which it is retained for.
SUFFIX = MIN_WORDS - WINDOW + 1
#: Suffixes of one key that a task compares word by word; more are compared as passages, over all tasks.
RUN = 20_000
#: Bytes hashed at once.
CHUNK = 1 << 20
#: Bytes of results in one batch.
OUT_BYTES = 4 << 20
WORD = re.compile(rb"[^\x20\x09-\x0D]+")

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = np.arange(1, 257, dtype=np.uint64)
_VALUE[65:91] += np.uint64(32)
_VALUE[_SPACE] = 0
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


_TABLES: dict[int, np.ndarray] = {}


def _pow(base: int, n: int) -> np.ndarray:
    """The first n powers; the table of each base grows as it has to."""
    table = _TABLES.get(base)
    if table is None or len(table) < n:
        table = np.full(max(1 << 16, 1 << (n - 1).bit_length()), base, np.uint64)
        table[0] = 1
        table = _TABLES[base] = np.multiply.accumulate(table)
    return table[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hash of every word (parts between ASCII white space, A-Z lower-cased), in order."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + CHUNK)
        if end < len(raw):
            space = WORD.match(raw, end - 1)  # to the end of the word that is being cut, if any
            end = space.end() if space else end
        a = np.frombuffer(raw, np.uint8, end - at, at)
        gap = _SPACE[a]
        edge = np.flatnonzero(np.diff(np.r_[True, gap, True].astype(np.int8)))
        first, last = edge[::2], edge[1::2]
        sums = np.r_[np.uint64(0), np.cumsum(_VALUE[a] * _pow(_BASE, len(a)))]
        h = (sums[last] - sums[first]) * _pow(_INVERSE, len(a) + 1)[first]
        out.append(_mix(h ^ (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def word_edges(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end."""
    gap = _SPACE[np.frombuffer(raw, np.uint8)]
    edge = np.flatnonzero(np.diff(np.r_[True, gap, True].astype(np.int8)))
    return edge[::2], edge[1::2]


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n words in a row."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    sums = np.r_[np.uint64(0), np.cumsum(h * _pow(_BASE, len(h)))]
    return _mix((sums[n:] - sums[:-n]) * _pow(_INVERSE, len(h))[: len(h) - n + 1] + np.uint64(n))


def _sliding(x: np.ndarray, n: int, best) -> np.ndarray:
    size = 1
    while size * 2 <= n:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Retained positions, and of each the least and greatest start of the passages it stands for.

    A passage of MIN_WORDS words is stood for by the least of its grams (the leftmost of ties), which its
    own words alone decide; the starts that share a position are a range."""
    n = len(h) - MIN_WORDS + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 3
    g = rolling(h, GRAM)
    least = _sliding(np.arange(len(g)), WINDOW, lambda a, b: np.where(g[a] <= g[b], a, b))[:n]
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    return least[first], first, np.r_[first[1:], n] - 1


def suffix_rows(docs: DataFrame) -> DataFrame:
    """docs (did, nul, row, text) -> one row for each retained suffix.

    k1, k2: its place in the order of suffixes: its first two words by the upper half of their hashes,
    then the hash of its first SUFFIX words.  at: its position, the words before and from it that its
    passages reach over, and nul, in one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list[np.ndarray]] = [[], [], [], [], []]
            for did, nul, row, text in zip(b["did"].to_pylist(), b["nul"].to_pylist(), b["row"].to_pylist(), b["text"], strict=True):
                h = word_hashes(text.as_py())
                pos, lo, hi = anchors(h)
                if len(pos):
                    k1 = (h[pos] & np.uint64(0xFFFFFFFF00000000)) | h[pos + 1] >> np.uint64(32)
                    at = ((pos << 8 | pos - lo) << 8 | hi + MIN_WORDS - pos) << 1 | int(nul)
                    for c, x in zip(cols, (k1.view(np.int64), rolling(h, SUFFIX)[pos].view(np.int64), np.full(len(pos), did), np.full(len(pos), row), at), strict=True):
                        c.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in cols], ["k1", "k2", "did", "row", "at"])

    return docs.select("did", "nul", "row", "text").mapInArrow(run, "k1 long, k2 long, did long, row long, at long")


#: What is known of a suffix: its key stands in several documents; undecided, as its run reaches the
#: edge of a sorted partition; in several documents, and so are those of its key beyond the edge.
SHARED, OPEN, SHARED_AT_EDGE = 0, 1, 2


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted suffixes of a partition -> those with a neighbour of the same key in another document.

    Only rows of a run that has shown one document so far are held back, and the last row of any run."""
    held: list[pa.RecordBatch] = []
    key = doc = None
    shared, at_start = False, True

    def out(b: pa.RecordBatch, state: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b["k2"], b["did"], b["row"], b["at"], pa.array(np.full(b.num_rows, state, np.int8))], ["key", "did", "row", "at", "state"])

    for b in batches:
        if not b.num_rows:
            continue
        k1, k2, did, nul = b["k1"].to_numpy(), b["k2"].to_numpy(), b["did"].to_numpy(), b["at"].to_numpy() & 1
        first = np.flatnonzero(np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
        last = np.r_[first[1:], len(k1)]
        apart = np.r_[False, (did[1:] != did[:-1]) | (nul[1:] != nul[:-1])]
        apart[first] = False
        several = np.logical_or.reduceat(apart, first)
        goes_on = key == (k1[0], k2[0])
        if goes_on:
            several[0] |= shared or doc != (did[0], nul[0])
        final = len(first) - 1
        if not goes_on or several[0] or final:  # what is held is settled
            met = bool(several[0]) if goes_on else shared
            for x in held if met or at_start else ():
                yield out(x, OPEN if not met else SHARED_AT_EDGE if at_start else SHARED)
            held = []
        at_start &= key is None or goes_on  # of this batch's first run
        state = np.full(len(k1), -1, np.int8)
        state[np.repeat(several, last - first)] = SHARED
        if at_start:
            state[: last[0]] = SHARED_AT_EDGE if several[0] else OPEN if final else -1
        if several[final]:
            state[-1] = -1
        for kind in (SHARED, OPEN, SHARED_AT_EDGE):
            if (state == kind).any():
                yield out(b.filter(pa.array(state == kind)), kind)
        held.append(b.slice(len(k1) - 1) if several[final] else b.slice(first[final]))
        key, doc, shared, at_start = (k1[-1], k2[-1]), (did[-1], nul[-1]), bool(several[final]), at_start and not final
    for x in held:
        yield out(x, SHARED_AT_EDGE if shared else OPEN)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_neighbours() with the places of a key in a document in one row, as far as they follow each other in a batch:
    a text that repeats a line a thousand times has one row for it.  Equal rows have one place."""
    for b in _neighbours(batches):
        key, did, row, at, state = (c.to_numpy() for c in b.columns)
        other = (key[1:] != key[:-1]) | (did[1:] != did[:-1]) | (row[1:] != row[:-1]) | ((at[1:] ^ at[:-1]) & 1 > 0)
        kept = np.flatnonzero(np.r_[True, other | (at[1:] != at[:-1])])
        first = np.flatnonzero(np.r_[True, other])
        places = pa.ListArray.from_arrays(pa.array(np.searchsorted(kept, np.r_[first, len(at)]).astype(np.int32)), pa.array(at[kept]))
        yield pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(did[first]), pa.array(row[first]), places, pa.array(state[first])], b.schema.names)


def shared_suffixes(docs: DataFrame) -> DataFrame:
    """_keyed docs -> a table (key, did, row, at: array, state) of the retained suffixes whose first SUFFIX words
    stand in another document too, as far as equal hashes tell; words are compared later.

    Suffixes are sorted over all partitions and compared with their neighbours.  The documents are part
    of the order, so a key of a third of all rows is spread over as many partitions as it fills; runs
    that reach the edge of a partition are settled by their keys, two at most for each partition."""
    suffixes = cut(suffix_rows(docs))
    # the place in the table is part of the ranges, so that not even equal rows have to be in one partition
    dealt = suffixes.withColumn("place", F.monotonically_increasing_id()).repartitionByRange("k1", "k2", "did", "row", "place")
    dealt = dealt.sortWithinPartitions("k1", "k2", "did", "row", "at").select("k1", "k2", "did", "row", "at")
    found = cut(dealt.mapInArrow(_gathered, "key long, did long, row long, at array<long>, state byte"), files_for(suffixes))
    drop(suffixes)
    doc = F.struct(F.col("did"), F.element_at("at", 1) % 2)
    edge = found.where(F.col("state") != SHARED).groupBy(F.col("key").alias("ek")).agg(F.min(doc).alias("lo"), F.max(doc).alias("hi"), F.max("state").alias("most"))
    edge = cut(edge.where((F.col("most") == SHARED_AT_EDGE) | (F.col("lo") != F.col("hi"))).select("ek"), files_for(found))
    more = found.where(F.col("state") == OPEN).join(small(edge, edge.count()), F.col("key") == F.col("ek")).drop("ek")
    hits = cut(found.where(F.col("state") != OPEN).unionByName(more))
    drop(found, edge)
    return hits


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their shared suffixes, in any order -> for each suffix the words that its passages reach over."""
    names = ["key", "nul", "did", "row", "before", "words", "pos"]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32())]
    for b in batches:
        rows, size = [], 0
        for did, row, text, hits in zip(b["did"].to_pylist(), b["row"].to_pylist(), b["text"], b["hits"], strict=True):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass").lower()
            first, last = word_edges(raw)
            lists = hits.values.field("at")
            keys = np.repeat(hits.values.field("key").to_numpy(), lists.value_lengths().to_numpy())
            found = dict.fromkeys(zip(keys.tolist(), lists.flatten().to_numpy().tolist(), strict=True))  # lists of several tasks may share places
            key_, at = (np.array(x, np.int64) for x in zip(*found, strict=True))
            places: dict[tuple, list[int]] = {}  # a text that goes round in circles has each slice once
            for key, pos, before, after in zip(key_.tolist(), (at >> 17).tolist(), (at >> 9 & 255).tolist(), (at >> 1 & 255).tolist(), strict=True):
                words = b" ".join(raw[first[pos - before] : last[pos + after - 1]].split())
                places.setdefault((key, before, words), []).append(pos)
            for (key, before, words), pos in places.items():
                rows.append((key, bool(at[0] & 1), did, row, before, words, pos))
                size += len(words) + 4 * len(pos)
                if size > OUT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _ordered(run: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of rows by run and words, how many columns each has in common with its neighbour before)."""
    m = np.ascontiguousarray(np.column_stack([run, words]).astype(">u4"))
    order = np.argsort(m.view(f"S{4 * m.shape[1]}").ravel(), kind="stable")
    m = m[order]
    differs = m[1:] != m[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), m.shape[1]) if len(m) > 1 else np.zeros(0, np.int64)
    return order, common


def _classes(order: np.ndarray, common: np.ndarray, words: int) -> np.ndarray:
    """Number of the class of each row: equal run and equal first words."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(np.r_[0, common < words + 1])
    return out


def extended(t: pa.Table) -> list[np.ndarray]:
    """Whole runs of slices -> row number, words before the suffix at which the repeated passages begin
    first and last, removed, and the row whose document is the first with such a passage.

    Runs are sorted by the words from the suffix on, and by those before it, read backwards; what
    neighbours have in common tells how far each match extends to the right and to the left.  A passage
    beginning o words before the suffix repeats if rows agree in o words to the left and the rest to the right."""
    key, before = t["key"].to_numpy(), t["before"].to_numpy().astype(np.int64)
    split = pc.split_pattern(t["words"].combine_chunks(), " ")
    length = split.value_lengths().to_numpy().astype(np.int64)
    code = split.flatten().dictionary_encode().indices.to_numpy().astype(np.int64) + 1
    off = np.r_[0, np.cumsum(length)[:-1]]
    after = length - before
    did, nul = t["did"].to_numpy(), t["nul"].to_numpy()
    by_doc = np.lexsort((did, nul))
    rank = np.empty(len(did), np.int64)
    rank[by_doc] = np.cumsum(np.r_[0, (np.diff(did[by_doc]) != 0) | (nul[by_doc][1:] != nul[by_doc][:-1])])
    row_of = np.empty(rank.max() + 1, np.int64)
    row_of[rank] = np.arange(len(did))
    run = np.cumsum(np.r_[0, key[1:] != key[:-1]])

    def words(n: int, have: np.ndarray, step: int) -> np.ndarray:
        at = (off + before + min(step, 0))[:, None] + step * np.arange(n)
        return np.where(np.arange(n) < have[:, None], code[np.clip(at, 0, len(code) - 1)], 0)

    right = _ordered(run, words(MIN_WORDS, after, 1))
    left = _ordered(run, words(WINDOW - 1, before, -1))
    low, high, first = (np.full((2, len(did)), v) for v in (-1, -1, len(did)))
    for o in range(WINDOW):
        has = np.flatnonzero((before >= o) & (after >= MIN_WORDS - o))
        if len(has) < 2:
            continue
        same = _classes(*left, o)[has] * len(did) + _classes(*right, MIN_WORDS - o)[has]
        order = np.argsort(same, kind="stable")
        same, has = same[order], has[order]
        begins = np.flatnonzero(np.r_[True, same[1:] != same[:-1]])
        size = np.diff(np.r_[begins, len(same)])
        lo = np.repeat(np.minimum.reduceat(rank[has], begins), size)
        hit = lo < np.repeat(np.maximum.reduceat(rank[has], begins), size)
        has, lo = has[hit], lo[hit]
        kind = (lo < rank[has]).astype(np.int64)
        low[kind, has] = np.where(low[kind, has] < 0, o, low[kind, has])
        high[kind, has] = o
        first[kind, has] = np.minimum(first[kind, has], lo)
    kind, row = np.nonzero(high >= 0)
    return [row, high[kind, row], low[kind, row], kind.astype(bool), row_of[first[kind, row]]]


_SPAN = "did long, row long, nul boolean, start_word int, end_word int, removed boolean, first_id long, first_nul boolean"
#: Matches of one suffix in its document.
_MATCH = "did long, row long, nul boolean, found array<struct<start_word:int,end_word:int,removed:boolean,first_id:bigint,first_nul:boolean>>"


def _match_batch(t: pa.Table) -> pa.RecordBatch:
    row, high, low, removed, first = extended(t)
    order = np.argsort(row, kind="stable")
    row, high, low, removed, first = (x[order] for x in (row, high, low, removed, first))
    pos = t["pos"].combine_chunks().take(pa.array(row))
    n = pos.value_lengths().to_numpy()
    at, many = pos.flatten().to_numpy(), lambda x: np.repeat(x, n)
    did, nul = t["did"].to_numpy(), t["nul"].to_numpy()
    start, end = (at - many(high)).astype(np.int32), (at - many(low) + MIN_WORDS).astype(np.int32)
    found = pa.StructArray.from_arrays([pa.array(x) for x in (start, end, many(removed), did[many(first)], nul[many(first)])], ["start_word", "end_word", "removed", "first_id", "first_nul"])
    rows = np.unique(row)
    ends = np.searchsorted(many(row), rows, side="right")
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), found)
    return pa.RecordBatch.from_arrays([pa.array(did[rows]), pa.array(t["row"].to_numpy()[rows]), pa.array(nul[rows]), lists], ["did", "row", "nul", "found"])


def _extend(run: int):
    """Slices sorted by key -> matches; whole runs are compared together, about `run` rows at a time."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for t in whole_runs(batches, ("key",)):
            held.append(t)
            rows += t.num_rows
            if rows > run:
                yield _match_batch(pa.concat_tables(held))
                held, rows = [], 0
        if held:
            yield _match_batch(pa.concat_tables(held))

    return go


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices -> each of their passages by the 128-bit XXH3 of its words."""
    for b in batches:
        ends, h, n, at = [], bytearray(), [], []
        for before, words, pos in zip(b["before"].to_pylist(), b["words"].to_pylist(), b["pos"].to_pylist(), strict=True):
            w = words.split(b" ")
            for p in pos:
                for s in range(len(w) - MIN_WORDS + 1):
                    h += xxhash.xxh3_128_digest(b" ".join(w[s : s + MIN_WORDS]))
                    at.append(p - before + s)
            n.append(len(pos) * (len(w) - MIN_WORDS + 1))
        both = np.frombuffer(bytes(h), np.int64).reshape(-1, 2)
        cols = [np.repeat(b[c].to_numpy(zero_copy_only=False), n) for c in ("nul", "did", "row")]
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), *map(pa.array, cols), pa.array(np.array(at, np.int32))], ["h1", "h2", "nul", "did", "row", "start_word"])


def _frequent(slices: DataFrame) -> DataFrame:
    """Spans of slices whose keys are too frequent for one task, by sums over their passages."""
    rows = cut(slices.mapInArrow(_passages, "h1 long, h2 long, nul boolean, did long, row long, start_word int"))
    doc = F.struct("nul", "did")
    firsts = rows.groupBy(F.col("h1").alias("f1"), F.col("h2").alias("f2")).agg(F.min(doc).alias("first"), F.max(doc).alias("last"))
    firsts = cut(firsts.where("first <> last").select("f1", "f2", "first"), files_for(rows))
    found = rows.join(firsts, (rows.h1 == firsts.f1) & (rows.h2 == firsts.f2))
    removed = (F.col("first.nul") != F.col("nul")) | (F.col("first.did") != F.col("did"))
    one = F.struct("start_word", (F.col("start_word") + MIN_WORDS).cast("int").alias("end_word"), removed.alias("removed"), F.col("first.did").alias("first_id"), F.col("first.nul").alias("first_nul"))
    spans = cut(found.groupBy("did", "row", "nul").agg(F.collect_list(one).alias("found")), files_for(rows))
    drop(rows, firsts)
    return spans


def _keyed(docs: DataFrame) -> DataFrame:
    nul = F.col("doc_id").isNull()
    return docs.withColumns({"nul": nul, "did": F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")), "row": F.xxhash64("doc_id", "text")})


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches of one document -> spans, apart for passages that begin here and elsewhere."""
    for b in batches:
        rows = []
        for did, row, nul, found in zip(b["did"].to_pylist(), b["row"].to_pylist(), b["nul"].to_pylist(), b["found"], strict=True):
            start, end, removed, first, first_nul = (found.values.field(c).to_numpy(zero_copy_only=False) for c in ("start_word", "end_word", "removed", "first_id", "first_nul"))
            for kind in (True, False):
                s = np.flatnonzero(removed == kind)
                s = s[np.argsort(start[s], kind="stable")]
                if not len(s):
                    continue
                reach = np.maximum.accumulate(end[s])
                new = np.flatnonzero(np.r_[True, start[s][1:] > reach[:-1]])
                for lo, hi in zip(new, np.r_[new[1:], len(s)], strict=True):
                    part = s[lo:hi]
                    of = part[np.lexsort((first[part], first_nul[part]))[0]]
                    rows.append((did, row, nul, int(start[part[0]]), int(reach[hi - 1]), kind, int(first[of]), bool(first_nul[of])))
        cols = list(zip(*rows, strict=True)) or [[]] * 8
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split(" ")[0] for x in _SPAN.split(", ")])


def find_spans(docs: DataFrame, run: int = RUN) -> DataFrame:
    """_keyed docs -> a table did, row, nul, start_word, end_word, removed, first_id, first_nul: see repeated_spans()."""
    hits = shared_suffixes(docs)
    most = files_for(hits)
    known = cut(hits.groupBy("did", "row").agg(F.collect_set(F.struct("key", "at")).alias("hits")), most)
    drop(hits)
    texts = docs.select("did", "row", "text")
    maybe = may_be_in(known.select(F.col("row").alias("key")), F.col("row"))
    if maybe is not None:
        texts = texts.where(maybe)
    slices = cut(texts.dropDuplicates(["did", "row"]).join(known, ["did", "row"]).mapInArrow(_slices, "key long, nul boolean, did long, row long, before int, words binary, pos array<int>"), 4 * most)
    most = files_for(slices)
    drop(known)
    heavy = cut(slices.groupBy(F.col("key").alias("hk")).count().where(F.col("count") > run).select("hk"), most)
    n = heavy.count()
    rare = slices.join(small(heavy, n), F.col("key") == F.col("hk"), "left_anti") if n else slices
    found = rare.repartition("key").sortWithinPartitions("key").mapInArrow(_extend(run), _MATCH)
    frequent = None
    if n:
        frequent = _frequent(slices.join(small(heavy, n), F.col("key") == F.col("hk"), "left_semi"))
        found = found.unionByName(frequent)
    found = cut(found, most)
    drop(slices, heavy, frequent)
    merged = found.groupBy("did", "row", "nul").agg(F.flatten(F.collect_list("found")).alias("found"))
    spans = cut(merged.mapInArrow(_merge, _SPAN), files_for(found))
    drop(found)
    return spans


def repeated_spans(docs: DataFrame, run: int = RUN) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, start_word, end_word, removed, first_doc_id: passages of at
    least MIN_WORDS words, in words from 0 (end exclusive), that stand in documents of different id.

    Suffixes are retained where a gram of 8 words is the least of a passage's 43, which depends on its
    words alone, so each passage has one retained suffix, at the same place in every copy.  Retained
    suffixes are sorted by their first words over all partitions and compared with their neighbours;
    those that share 8 words with another document fetch the words around them, are sorted by the words
    on either side, and matches are extended to the left and right as far as neighbours agree, word by
    word.  Keys with more than `run` suffixes are compared by the 128-bit hashes of their passages
    instead, with sums over all tasks.  A span is the union of the 50-word passages that occur in two
    documents.  removed: the passage stands in a document that comes before; where it is false, this
    is the first copy.

    Null, empty and short texts have no passages.  Rows with the same doc_id are one document.  Rows
    without an id come after all others, in the order of a hash of their text; each is a document of
    its own, but rows without id that have equal texts are repeats of one.  Equal rows are reported
    once.  Repeats inside one document are not reported.  An empty table gives no rows; other columns
    are ignored.
    """
    spans = find_spans(_keyed(docs.select("doc_id", "text")), run)
    return spans.select(F.when(~F.col("nul"), F.col("did")).alias("doc_id"), "start_word", "end_word", "removed", F.when(~F.col("first_nul"), F.col("first_id")).alias("first_doc_id"))


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of spans and the white space after them."""
    raw = text.encode("utf-8", "surrogatepass")
    first, _ = word_edges(raw)
    out, at = [], 0
    for lo, hi in sorted(spans):
        start = int(first[lo])
        end = int(first[hi]) if hi < len(first) else len(raw)
        out.append(raw[at : max(at, start)])
        at = max(at, end)
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def _cut_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        doc = b["doc"]
        names = [f.name for f in doc.type]
        cols = doc.flatten()
        at = names.index("text")
        texts = [cut_words(t, [(s["start_word"], s["end_word"]) for s in spans]) for t, spans in zip(cols[at].to_pylist(), b["spans"].to_pylist(), strict=True)]
        cols[at] = pa.array(texts, cols[at].type)
        yield pa.RecordBatch.from_arrays(cols, names)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> the same columns; later copies of repeated passages are cut out of text.

    The first copy, in the document of smallest id, stays.  A document of which nothing is left goes;
    texts without repeats, null and empty ones stay as they are.  See repeated_spans() for the rest.
    """
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "text")
    keyed = _keyed(keyed).drop("doc_id", "text", "nul")
    found = find_spans(_keyed(docs.select("doc_id", "text")))
    most = files_for(found)
    spans = found.where("removed")
    spans = cut(spans.groupBy(F.col("did").alias("sd"), F.col("row").alias("sr")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans")), most)
    drop(found)
    maybe = may_be_in(spans.select(F.col("sr").alias("key")), F.col("row"))
    some = keyed if maybe is None else keyed.where(maybe)
    joined = some.join(spans, (F.col("did") == F.col("sd")) & (F.col("row") == F.col("sr")), "left")
    out = joined.where("spans is not null").select("doc", "spans").mapInArrow(_cut_batch, docs.schema).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    out = out.unionByName(joined.where("spans is null").select("doc.*"))
    return out if maybe is None else out.unionByName(keyed.where(~maybe).select("doc.*"))
