"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

The alignment is relational: tokens are exploded with their places, a window sums their lengths to byte ends,
ends of both sides meet in an equi-join, a running count of the shared ends numbers the groups, and the links of
a group come from its two sides.  `align` does that for any key.  `aligned_documents` calls it with the distinct
pieces of the corpus as keys, not with documents: a text is cut before spaces at which neither tokenizer can join
what stands on both sides, so the tokens, groups and links of a text are those of its pieces in order.  A word
that stands a million times is tokenized and aligned once; what documents add up are numbers of pieces.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlode.llm.common import SORTED_SUMS, cut, drop, files_for, wave

TOKENIZERS = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text whose pieces share a dictionary; a longer text has one of its own.
CHUNK = 32 << 20
#: Pairs of documents counted at once in a task.
HELD = 1 << 21
#: Pieces of documents whose groups are joined at once.
JOINED = 1 << 16
#: A space after white space: there, a token may hold both.
_JOINED = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S) ")
#: The same for Arrow's expressions, with a space in front.
_ODD = r"^ |[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
#: Pieces that are encoded as one text.
TOGETHER = 1000


def pieces_of(text: str | None) -> list[str]:
    """The pieces of space + text, each without the space it begins with.

    Pieces begin at a space that follows no white space.  The byte-level tokenizer splits there in any case: its
    words take at most one space, in front.  The other one has no piece with a space behind another character,
    which `coders` makes sure of.  A run of spaces stays with the piece that it leads, or ends the one before it
    if white space of another kind precedes.  Null and empty texts have no pieces."""
    if not text:
        return []
    return _CUT.split(text) if text[0] == " " or _JOINED.search(text) else text.split(" ")


def byte_alphabet() -> dict[str, int]:
    """Character of a byte-level vocabulary -> byte: printable ones stand for themselves, the others are numbered from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Coders:
    """Both tokenizers of a task, with the bytes of each token."""

    def __init__(self, folder: str, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(f"{folder}/{a_file}")
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{b_file}")
        alphabet = byte_alphabet()
        self.a_bytes = [bytes(alphabet[c] for c in self.a.id_to_token(i)) for i in range(self.a.get_vocab_size())]
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if bad := next((n for n in names if re.search("[^▁]▁", n)), None):
            raise ValueError(f"pieces of this tokenizer reach over spaces: {bad}")
        self.b_bytes = [bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.a_lens, self.b_lens = (np.array([len(t) for t in table], np.int32) for table in (self.a_bytes, self.b_bytes))
        self.space = self.b.piece_to_id("▁")

    def encode(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of space + piece on both sides, without special tokens."""
        a = [e.ids for e in self.a.encode_batch_fast([f" {p}" for p in pieces], add_special_tokens=False)]
        b = self.b.encode(pieces, num_threads=1)
        return a, [ids if p else [self.space] for p, ids in zip(pieces, b, strict=True)]

    def tokens(self, pieces: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Which pieces both sides give back byte for byte; and for each side the ids of those, and where each piece's begin.

        Pieces are encoded many at once, as the text that they make up, and told apart by bytes.  Those that would
        run together with their neighbours, and batches in which a side changes bytes, are encoded one by one."""
        alone, found = [], []
        for lo in range(0, len(pieces), TOGETHER):
            at = [i for i in range(lo, min(lo + TOGETHER, len(pieces))) if (p := pieces[i]) and not p[0].isspace() and not p[-1].isspace()]
            alone += sorted(set(range(lo, min(lo + TOGETHER, len(pieces)))).difference(at))
            if at:
                text = " ".join([pieces[i] for i in at])
                raw = f" {text}".encode()
                ids = self.a.encode(f" {text}", add_special_tokens=False).ids, self.b.encode(text)
                if all(b"".join([table[t] for t in x]) == raw for x, table in zip(ids, (self.a_bytes, self.b_bytes), strict=True)):
                    ends = np.cumsum([len(pieces[i].encode()) + 1 for i in at])
                    found.append((at, [self._told_apart(np.array(x, np.int32), lengths, ends) for x, lengths in zip(ids, (self.a_lens, self.b_lens), strict=True)]))
                else:
                    alone += at
        if alone:
            a, b = self.encode([pieces[i] for i in alone])
            same = lambda ids, table, p: b"".join([table[t] for t in ids]) == f" {p}".encode()
            good = [k for k, i in enumerate(alone) if same(a[k], self.a_bytes, pieces[i]) and same(b[k], self.b_bytes, pieces[i])]
            flat = lambda side: (np.fromiter(chain.from_iterable(side[k] for k in good), np.int32), np.array([len(side[k]) for k in good], np.int64))
            found.append(([alone[k] for k in good], [flat(a), flat(b)]))
        whole = np.array(list(chain.from_iterable(at for at, _ in found)), np.int64)
        none = np.empty(0, np.int32)
        sides = [(np.concatenate([none, *(x[k][0] for _, x in found)]), np.r_[0, np.cumsum(np.concatenate([none, *(x[k][1] for _, x in found)]))]) for k in (0, 1)]
        return whole, sides

    @staticmethod
    def _told_apart(ids: np.ndarray, lengths: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids with the number of them in each piece; no token crosses the end of a piece."""
        last = np.searchsorted(np.cumsum(lengths[ids]), ends)
        return ids, np.diff(np.r_[0, last + 1])


@lru_cache(2)
def coders(folder: str, a_file: str, b_file: str) -> Coders:
    return Coders(folder, a_file, b_file)


TOKENS = "array<struct<id: int, len: int>>"


def tokenized(spots: DataFrame, parts: int, folder: str = TOKENIZERS, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """chunk, n, piece -> key of the piece with either chunk and n (a row for each row), or a and b: arrays of (id, length in bytes)
    (a row for each distinct piece that both sides give back byte for byte).

    Rows are dealt and sorted by piece, so that equal ones follow each other: one shuffle both finds the distinct
    pieces and names their places.  key numbers the pieces; it stands only once the table is written."""
    kind = pa.list_(pa.struct([("id", pa.int32()), ("len", pa.int32())]))

    def cells(ids: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.StructArray.from_arrays([pa.array(ids), pa.array(lengths[ids])], ["id", "len"])).cast(kind)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, key, last = coders(folder, a_file, b_file), (TaskContext.get().partitionId() << 40) - 1, None
        for batch in batches:
            texts = batch.column(2).to_pylist()
            new = np.fromiter((x != y for x, y in zip(texts, chain([last], texts))), bool, len(texts))  # noqa: B905
            keys = key + np.cumsum(new)
            yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0), batch.column(1), pa.nulls(len(texts), kind), pa.nulls(len(texts), kind)], ["key", "chunk", "n", "a", "b"])
            pieces = [texts[i] for i in np.flatnonzero(new)]
            if pieces:
                whole, (a, b) = both.tokens(pieces)
                yield pa.RecordBatch.from_arrays([pa.array(keys[new][whole]), pa.nulls(len(whole), pa.int64()), pa.nulls(len(whole), pa.int32()), cells(*a, both.a_lens), cells(*b, both.b_lens)], ["key", "chunk", "n", "a", "b"])
            key, last = int(keys[-1]) if len(keys) else key, texts[-1] if texts else last

    return spots.select("chunk", "n", "piece").repartition(parts, "piece").sortWithinPartitions("piece").mapInArrow(go, f"key long, chunk long, n int, a {TOKENS}, b {TOKENS}")


def align(encoded: DataFrame, key: str = "key", parts: int | None = None) -> DataFrame:
    """key, a, b (arrays of (id, len), of equal total length) -> key, groups: array of (a, b), the ids of both sides between two
    neighbouring byte ends that both have, in order.

    Tokens are exploded with their places; a window sums the lengths of a side to ends; a full equi-join of the
    sides on key and end pairs the ends that both have; a running count of those numbers the groups, and the rows of a number are a group.  The join is
    written as an aggregation of both sides by key and end (an end stands once on a side), because the rows, dealt
    by key before they are exploded (over `parts`, if given), then stay where they are: no token is shuffled.
    Lengths are positive.  A row without tokens gives none; null keys are one key and must not repeat."""
    dealt = encoded.select(key, "a", "b").repartition(*([parts] if parts else []), key)
    placed = lambda c, side: F.transform(c, lambda x, i: F.struct(F.lit(side).alias("side"), i.alias("pos"), x["id"].alias("id"), x["len"].alias("len")))
    rows = dealt.select(key, F.inline(F.concat(placed("a", 0), placed("b", 1))))
    ends = rows.select(key, "side", "id", F.sum("len").over(Window.partitionBy(key, "side").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)).alias("end"))
    both = ends.groupBy(key, "end").agg(F.max(F.when(F.col("side") == 0, F.col("id"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("id"))).alias("b"))
    earlier = Window.partitionBy(key).orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    shared = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1).otherwise(0)
    tokens = both.withColumn("gid", F.coalesce(F.sum(shared).over(earlier), F.lit(0)))
    gathered = tokens.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("end", "gid", "a", "b"))).alias("t"))
    t = F.col("t")
    gid = lambda i: F.get(t, i)["gid"]
    starts = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (gid(i) != gid(i - 1)))
    gathered = gathered.select(key, "t", starts.alias("s"))
    s = F.col("s")
    ids = lambda part, c: F.transform(F.filter(part, lambda x: x[c].isNotNull()), lambda x: x[c])
    parts_ = F.transform(s, lambda at, i: F.slice(t, at + 1, F.coalesce(F.get(s, i + 1), F.size(t)) - at))
    return gathered.select(key, F.transform(parts_, lambda part: F.struct(ids(part, "a").alias("a"), ids(part, "b").alias("b"))).alias("groups"))


def linked(aligned: DataFrame, key: str = "key") -> DataFrame:
    """align() -> key, n_a, n_b, n_groups, n_links, told (`a1,a2|b1;a3|b2,b3`), links: array of (pair, times).

    pair is A id * 2^32 + B id, times its linked occurrences in one group; a pair that several groups of a key
    link stands once for each.  The sides of a group are joined by their distinct ids inside the row that has both."""
    times = lambda ids, x: F.size(F.filter(ids, lambda y: y == x))
    pair = lambda g, x, y: F.struct((F.shiftleft(x.cast("long"), 32) + y).alias("pair"), (times(g["a"], x) * times(g["b"], y)).alias("times"))
    many = lambda g: F.flatten(F.transform(F.array_distinct(g["a"]), lambda x: F.transform(F.array_distinct(g["b"]), lambda y: pair(g, x, y))))
    one = lambda g: F.array(F.struct((F.shiftleft(F.get(g["a"], F.lit(0)).cast("long"), 32) + F.get(g["b"], F.lit(0))).alias("pair"), F.lit(1).alias("times")))
    links = F.flatten(F.transform("groups", lambda g: F.when((F.size(g["a"]) == 1) & (F.size(g["b"]) == 1), one(g)).otherwise(many(g))))
    total = lambda f: F.aggregate("groups", F.lit(0).cast("long"), lambda n, g: n + f(g))
    told = F.array_join(F.transform("groups", lambda g: F.concat_ws("|", F.array_join(g["a"], ","), F.array_join(g["b"], ","))), ";")
    return aligned.select(
        key, total(lambda g: F.size(g["a"])).alias("n_a"), total(lambda g: F.size(g["b"])).alias("n_b"), F.size("groups").cast("long").alias("n_groups"),
        total(lambda g: F.size(g["a"]).cast("long") * F.size(g["b"])).alias("n_links"), told.alias("told"), links.alias("links"),
    )


def packed(places: np.ndarray) -> bytes:
    """Places as bytes: their number, then all first bytes, all second bytes and so on, compressed."""
    planes = places.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(places).to_bytes(4, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(row: pa.BinaryScalar) -> np.ndarray:
    """The places that packed() was given."""
    raw = row.as_buffer()
    n = int.from_bytes(raw.slice(0, 4).to_pybytes(), "little")
    planes = np.frombuffer(pa.decompress(raw.slice(4), decompressed_size=4 * n, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<i4").ravel()


def _chunks(docs: DataFrame) -> DataFrame:
    """docs -> chunk, and either doc_id, at (places of its pieces in the chunk's dictionary, packed) or piece and its place n."""
    schema = "chunk long, doc_id long, at binary, n int, piece string"
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.string()]

    def told(chunk: int, ids: list[pa.Array], texts: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        def batch(rows, **cols):
            return pa.RecordBatch.from_arrays([pa.array(np.full(rows, chunk)), *(cols[c] if c in cols else pa.nulls(rows, t) for c, t in zip(("doc_id", "at", "n", "piece"), types[1:], strict=True))], ["chunk", "doc_id", "at", "n", "piece"])

        ids, texts = pa.concat_arrays(ids), pa.concat_arrays(texts)
        plain = pc.fill_null(pc.and_(pc.greater(pc.binary_length(texts), 0), pc.invert(pc.match_substring_regex(texts, _ODD))), False)
        odd = pc.invert(plain)
        lists = [pc.split_pattern(texts.filter(plain), " ").cast(pa.list_(pa.string())), pa.array([pieces_of(x) for x in texts.filter(odd).to_pylist()], pa.list_(pa.string()))]
        lists, ids = pa.concat_arrays(lists), pa.concat_arrays([ids.filter(plain), ids.filter(odd)])
        coded = lists.flatten().dictionary_encode()
        at, begin = coded.indices.to_numpy(), np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]
        for lo in range(0, len(ids), 1000):
            ends = begin[lo : lo + 1001]
            yield batch(len(part := ids.slice(lo, 1000)), doc_id=part, at=pa.array([packed(at[x:y]) for x, y in zip(ends, ends[1:], strict=False)], types[2]))
        for lo in range(0, len(coded.dictionary), 50_000):
            part = coded.dictionary.slice(lo, 50_000)
            yield batch(len(part), n=pa.array(np.arange(lo, lo + len(part), dtype=np.int32)), piece=part)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for b in batches:
            lengths = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy())
            lo = 0
            while lo < b.num_rows:
                # as many rows as still fit; a row that fits nowhere is a chunk of its own
                before = int(lengths[lo - 1]) if lo else 0
                hi = int(np.searchsorted(lengths, before + CHUNK - size, "right"))
                hi = max(hi, lo + (not size))
                if hi > lo:
                    ids.append(b.column(0).slice(lo, hi - lo))
                    texts.append(b.column(1).slice(lo, hi - lo))
                    size += int(lengths[hi - 1]) - before
                    lo = hi
                if lo < b.num_rows:
                    yield from told(chunk, ids, texts)
                    chunk, ids, texts, size = chunk + 1, [], [], 0
        if ids:
            yield from told(chunk, ids, texts)
        # the worker lives on for the steps that follow: what its chunks took is given back to the system
        del ids, texts
        pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(go, schema)


def _placed(table: pa.Table, name: str) -> pa.Array:
    return table.column(name).combine_chunks()


def _row_of(table: pa.Table) -> np.ndarray:
    """The row of each place of a dictionary; its rows come in any order and need not be copied into theirs."""
    n = _placed(table, "n").to_numpy()
    rows = np.empty(len(n), np.int32)
    rows[n] = np.arange(len(n), dtype=np.int32)
    return rows


def _pair_counts(left: pa.Table, right: pa.Table) -> pa.Table:
    """Documents of a chunk and its dictionary's links -> pair, docs: in how many of them it is linked."""
    row_of, pairs = _row_of(right), _placed(right, "pairs")
    whole = pairs.is_valid().to_numpy(zero_copy_only=False)
    lengths = pairs.value_lengths().fill_null(0).to_numpy()
    first, links_ = np.r_[0, np.cumsum(lengths, dtype=np.int64)], pairs.flatten().to_numpy()
    found, held, out = [], 0, []

    def settle():
        out.append(np.unique(np.concatenate(found), return_counts=True))
        found.clear()

    for column in left.column("at").chunks:
        for row in column:
            mine = row_of[np.unique(unpacked(row))]
            if not len(mine) or not whole[mine].all():
                continue
            n = lengths[mine].astype(np.int64)
            places = np.repeat(first[mine] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            found.append(np.unique(links_[places]))
            held += len(found[-1])
            if held > HELD:
                settle()
                held = 0
    if found:
        settle()
    pair, docs = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64))
    return pa.table({"pair": pa.array(pair, pa.int64()), "docs": pa.array(docs, pa.int64())})


NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
#: Numbers that are n_a for a piece whose groups have one token on either side.
UNEQUAL = NUMBERS[1:4]


def _assembled(left: pa.Table, right: pa.Table) -> pa.Table:
    """Documents of a chunk with its dictionary's numbers -> the rows of the result."""
    row_of, told = _row_of(right), _placed(right, "told")
    whole = told.is_valid().to_numpy(zero_copy_only=False)
    values, more = np.zeros((right.num_rows, len(NUMBERS)), np.int64), _placed(right, "more")
    for k, c in enumerate(NUMBERS):
        values[:, k] = _placed(right, "n_a" if c in UNEQUAL else c).fill_null(0).to_numpy()
    values[more.is_valid().to_numpy(zero_copy_only=False), 1:4] += more.flatten().to_numpy().reshape(-1, len(UNEQUAL))
    told = told.cast(pa.large_binary())
    sums, hashes, held = np.zeros((left.num_rows, len(NUMBERS)), np.int64), [""] * left.num_rows, {}

    def settle():
        rows, begin = np.concatenate([*held.values()]), np.r_[0, np.cumsum([len(x) for x in held.values()])]
        sums[[*held]] = np.add.reduceat(values.take(rows, axis=0), begin[:-1])
        groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(begin, pa.int32()), told.take(pa.array(rows))), pa.scalar(b";", told.type))
        for i, x in zip(held, groups, strict=True):
            hashes[i] = hashlib.sha256(x.as_buffer()).hexdigest()
        held.clear()

    for i, row in enumerate(chain.from_iterable(left.column("at").chunks)):
        mine = row_of[unpacked(row)]
        if len(mine) and whole[mine].all():
            held[i] = mine
            if sum(map(len, held.values())) > JOINED:
                settle()
    if held:
        settle()
    return pa.table({"doc_id": left.column("doc_id"), **{c: pa.array(sums[:, k]) for k, c in enumerate(NUMBERS)}, "groups_sha256": pa.array(hashes, pa.string())})


def aligned_documents(docs: DataFrame, folder: str = TOKENIZERS, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; a row for each row.

    Null and empty texts, and texts that a side does not give back byte for byte, have zeros and an empty
    groups_sha256.  Rows with null or repeated ids count as documents of their own; other columns are ignored;
    an empty table gives no rows.  A text of any length is one row of a chunk; what a task holds is a chunk of
    CHUNK bytes or one longer text, with its distinct pieces."""
    chunks = cut(_chunks(docs), codec="zstd")
    words = cut(tokenized(chunks.where("piece is not null"), files_for(chunks), folder, a_file, b_file), codec="zstd")
    of_docs = cut(chunks.where("piece is null").select("chunk", "doc_id", "at"))
    drop(chunks)
    facts = cut(linked(align(words.where("a is not null"), parts=files_for(words, 2))), codec="zstd", settings=SORTED_SUMS)
    spots = cut(words.where("a is null").select("chunk", "n", F.col("key").alias("k")), codec="zstd")
    drop(words)
    pairs = spots.join(facts.select("key", F.col("links.pair").alias("pairs")), F.col("k") == F.col("key"), "left").drop("k", "key")
    seen = of_docs.select("chunk", "at").groupBy("chunk").cogroup(pairs.groupBy("chunk")).applyInArrow(_pair_counts, "pair long, docs long")
    counts = cut(seen.groupBy("pair").agg(F.sum("docs").alias("docs")), wave(docs.sparkSession))
    top = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("docs").alias("top"))
    ranked = counts.select("pair", "docs", F.shiftright("pair", 32).alias("x")).join(top, F.col("x") == F.col("a")).select(F.col("pair").alias("of"), "docs", (F.col("docs") == F.col("top")).alias("best"))
    # a pair that only documents without tokens hold is in no count; none of its pieces is ever added up
    each = facts.select("key", F.inline("links")).join(ranked, F.col("pair") == F.col("of"))
    sums = each.groupBy(F.col("key").alias("s")).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    told = cut(facts.drop("links").join(sums, F.col("key") == F.col("s"), "left").drop("s"), codec="zstd")
    drop(facts, counts)
    numbers = ", ".join(f"{c} long" for c in NUMBERS)
    # most pieces have groups of one token on either side: what differs from that is stored, and is mostly null
    more = F.when(F.greatest(*UNEQUAL) != F.least("n_a", *UNEQUAL), F.array(*[F.col(c) - F.col("n_a") for c in UNEQUAL])).alias("more")
    entries = cut(spots.join(told.select("key", "told", "n_a", more, "n_best", "count_sum"), F.col("k") == F.col("key"), "left").drop("k", "key"), codec="zstd")
    drop(spots, told)
    return of_docs.groupBy("chunk").cogroup(entries.groupBy("chunk")).applyInArrow(_assembled, f"doc_id long, {numbers}, groups_sha256 string")
