"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE, OTHER = 0x20, 0xFFFF
MAX_N = 4
#: Symbols whose n-grams are counted at once, so that memory does not follow a text's length.
CHUNK = 1 << 20


@lru_cache(1)
def _symbols() -> np.ndarray:
    """Code point -> 16-bit symbol: letters stand for themselves (beyond the BMP: OTHER), all else is a space."""
    table = np.full(0x110000, SPACE, np.uint16)
    letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    table[letters] = np.minimum(np.flatnonzero(letters), OTHER)
    return table


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of 1 to 4 letters, words padded by one space, as 16 bits a letter, and their counts."""
    sym = _symbols()[np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")]
    gap = sym == SPACE
    sym = sym[~(gap & np.r_[True, gap[:-1]])] if len(sym) else sym
    if not len(sym):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sym = np.r_[np.uint16(SPACE), sym, np.full(1 if sym[-1] != SPACE else 0, SPACE, np.uint16)]
    parts = []
    for at in range(0, len(sym), CHUNK):
        s = sym[at : at + CHUNK + MAX_N - 1].astype(np.uint64)
        inner, code, found = s != SPACE, s, []
        size = min(CHUNK, len(sym) - at)
        found.append(s[:size][inner[:size]])
        whole = np.ones(len(s), bool)
        for n in range(2, MAX_N + 1):
            if len(s) < n:
                break
            code = code[:-1] << np.uint64(16) | s[n - 1 :]
            if n > 2:
                whole = whole[: len(code)] & inner[n - 2 : n - 2 + len(code)]
            else:
                whole = whole[: len(code)]
            found.append(code[:size][whole[:size]])
        parts.append(np.unique(np.concatenate(found), return_counts=True))
    if len(parts) == 1:
        return parts[0]
    codes, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)


def most_frequent(codes: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The k most frequent codes in rank order; ties by code."""
    if len(codes) > k:
        least = np.partition(counts, len(counts) - k)[len(counts) - k]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))[:k]]


@dataclass
class Profiles:
    """langs, and for each known n-gram (sorted) its rank in every language, -1 where it has none."""

    langs: list[str]
    codes: np.ndarray
    ranks: np.ndarray
    k: int

    @classmethod
    def of(cls, ranked: dict[str, list[int]], k: int) -> Profiles:
        langs = sorted(ranked)
        codes = np.unique(np.array([c for v in ranked.values() for c in v], np.uint64))
        ranks = np.full((len(codes), len(langs)), -1, np.int32)
        for j, lang in enumerate(langs):
            ranks[np.searchsorted(codes, np.array(ranked[lang], np.uint64)), j] = np.arange(len(ranked[lang]))
        return cls(langs, codes, ranks, k)

    def judge(self, text: str | None) -> tuple[str, float]:
        """Language of least out-of-place distance (ties: the first by name) and 1 - distance / greatest distance."""
        top = most_frequent(*grams(text), self.k)
        if not len(top) or not self.langs:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        rank = np.where((self.codes[at] == top)[:, None], self.ranks[at], -1)
        far = np.where(rank < 0, self.k, np.abs(rank - np.arange(len(top))[:, None]))
        total = far.sum(axis=0)
        best = int(total.argmin())
        return self.langs[best], float(1 - total[best] / (self.k * len(top)))


def learn(labelled: DataFrame, k: int = 300, docs_per_language: int = 2000) -> Profiles:
    """Rank-order profiles from labelled (doc_id, text, lang).

    The sample is bounded: about docs_per_language documents of each language, chosen by a hash of
    doc_id so that reruns agree; their n-grams are counted on the executors, summed, and only each
    language's k most frequent reach the driver.  Rows with a null lang are left out.
    """
    labelled = labelled.where("lang is not null")
    have = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not have:
        return Profiles([], np.zeros(0, np.uint64), np.zeros((0, 0), np.int32), k)
    share = F.lit(0.0)
    for lang, n in have.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, docs_per_language / n))).otherwise(share)
    sample = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, list] = defaultdict(list)
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                by[lang].append(grams(text.as_py()))
            for lang, found in by.items():
                codes, where = np.unique(np.concatenate([x[0] for x in found]), return_inverse=True)
                n = np.bincount(where, np.concatenate([x[1] for x in found]), minlength=len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counts = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ranked: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for r in top.select("lang", "rank", "gram").collect():  # k rows a language
        ranked[r.lang].append((r.rank, r.gram % (1 << 64)))
    return Profiles.of({lang: [g for _, g in sorted(v)] for lang, v in ranked.items()}, k)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, lang_pred, score for every row.

    The whole text is counted, in pieces of bounded memory.  A null text, one without letters, or no
    profiles at all: `und`, 0.  Ties in a document's ranks go by n-gram, ties between languages by
    name.  Null and repeated doc_ids pass through row by row; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [profiles.judge(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of doc_id as text, modulo folds; null where doc_id is."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds
