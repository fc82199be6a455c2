"""Quality classifier: a generalised additive model with pairwise interactions, boosted cyclically."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlode.llm.common import cut, drop, small, wave

FEATURES = (
    "log_chars", "log_words", "word_len", "word_len_sd", "short_words", "long_words", "distinct_words",
    "upper", "upper_words", "digits", "stops", "commas", "marks", "symbols", "non_ascii", "line_len",
    "repeated_lines", "sentence_words", "symbol_words", "entropy", "newlines", "top_word",
)

_CLASS = np.zeros(256, np.uint8)
for _i, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".", b",;:", b"!?", b"\n", b" \t\r\x0b\x0c"), 1):
    _CLASS[list(_set)] = _i
_CLASS[128:] = 9
_SYMBOLS = b"#$%&*|<>{}[]=+\\^~_@/"


def features(text: str | None) -> list[float]:
    """Counts and shapes of the whole text; zero for an empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(FEATURES)
    a = np.frombuffer(raw, np.uint8)
    by = np.bincount(a, minlength=256)
    of = np.bincount(_CLASS, by, minlength=10)
    n = float(len(raw))
    words = raw.split()
    m = float(max(1, len(words)))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x]
    letters = of[1] + of[2] + of[9]
    p = by[by > 0] / n
    upper_words = symbol_words = 0
    for w, c in counts.items():
        if w.isupper() and len(w) > 1:
            upper_words += c
        if w[-1] in _SYMBOLS:
            symbol_words += c
    stops = of[4] + of[6]
    return [
        float(np.log1p(n)), float(np.log1p(m)), float(lengths.mean()), float(lengths.std()),
        float((lengths <= 3).mean()), float((lengths > 12).mean()), len(counts) / m,
        of[1] / max(1.0, letters), upper_words / m, of[2 + 1] / n, of[4] / m, of[5] / m, of[6] / m,
        float(by[list(_SYMBOLS)].sum()) / n, of[9] / n, n / max(1, len(lines)),
        1 - len(set(lines)) / max(1, len(lines)), m / (1 + stops), symbol_words / m,
        float(-(p * np.log2(p)).sum()), of[7] / m, max(counts.values(), default=0) / m,
    ]


@dataclass
class Gam:
    """Lookup tables: one value for each bin of each feature, one for each cell of each chosen pair."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += t[np.searchsorted(e, x[:, j], side="right")]
        for (i, j), g in zip(self.pairs, self.grids, strict=True):
            total += g[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def _shallow(g: np.ndarray, h: np.ndarray, leaves: int = 3, reg: float = 1.0) -> np.ndarray:
    """Values over ordered bins of a tree of at most `leaves` leaves, by greatest gain of the summed gradients."""
    cuts = [0, len(g)]
    sg, sh = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
    for _ in range(leaves - 1):
        best, where = 1e-9, None
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi - lo < 2:
                continue
            c = np.arange(lo + 1, hi)
            lg, lh, rg, rh = sg[c] - sg[lo], sh[c] - sh[lo], sg[hi] - sg[c], sh[hi] - sh[c]
            gain = np.where((lh > 0.5) & (rh > 0.5), lg**2 / (lh + reg) + rg**2 / (rh + reg), -1) - (sg[hi] - sg[lo]) ** 2 / (sh[hi] - sh[lo] + reg)
            k = int(gain.argmax())
            if gain[k] > best:
                best, where = gain[k], int(c[k])
        if where is None:
            break
        cuts = sorted([*cuts, where])
    out = np.zeros(len(g))
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        out[lo:hi] = (sg[hi] - sg[lo]) / (sh[hi] - sh[lo] + reg)
    return out


def _shallow_grid(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree over a grid: one split of either axis, then each side by the other; and its gain."""
    best = (np.zeros_like(g), 0.0)
    for axis in (0, 1):
        gg, hh = (g, h) if axis == 0 else (g.T, h.T)
        for c in range(1, gg.shape[0]):
            out = np.zeros_like(gg)
            for part in (slice(0, c), slice(c, None)):
                out[part] = _shallow(gg[part].sum(0), hh[part].sum(0), leaves=2)[None, :]
            gain = float((out * gg).sum())
            if gain > best[1]:
                best = (out if axis == 0 else out.T, gain)
    return best


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 150, rate: float = 0.15, n_pairs: int = 6, pair_bins: int = 8) -> Gam:
    """Cyclic boosting: in every round each feature in turn gets a shallow tree on the gradients of the
    log loss, added to its table at a small rate; then the pairs whose grids explain most of what is
    left get tables the same way.  One class only, or no rows: a constant."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Gam(float(np.log(share / (1 - share))), [_edges(c, bins) for c in x.T], [])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    model.coarse = [_edges(c, pair_bins) for c in x.T]
    if not len(y) or y.min() == y.max():
        return model
    at = [np.searchsorted(e, c, side="right") for e, c in zip(model.edges, x.T, strict=True)]
    f = np.full(len(y), model.base)
    for _ in range(rounds):
        for j, b in enumerate(at):
            p = 1 / (1 + np.exp(-f))
            size = len(model.tables[j])
            step = rate * _shallow(np.bincount(b, y - p, size), np.bincount(b, p * (1 - p), size))
            model.tables[j] += step
            f += step[b]
    near = [np.searchsorted(e, c, side="right") for e, c in zip(model.coarse, x.T, strict=True)]
    width = [len(e) + 1 for e in model.coarse]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        cell = near[i] * width[j] + near[j]
        return tuple(np.bincount(cell, v, width[i] * width[j]).reshape(width[i], width[j]) for v in (y - p, p * (1 - p)))

    d = x.shape[1]
    gains = sorted(((_shallow_grid(*sums(i, j))[1], i, j) for i in range(d) for j in range(i + 1, d)), reverse=True)
    model.pairs = [(i, j) for gain, i, j in gains[:n_pairs] if gain > 0]
    model.grids = [np.zeros((width[i], width[j])) for i, j in model.pairs]
    for _ in range(rounds // 5):
        for q, (i, j) in enumerate(model.pairs):
            step = rate * _shallow_grid(*sums(i, j))[0]
            model.grids[q] += step
            f += step[near[i], near[j]]
    return model


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 8000) -> Gam:
    """A model from labels (doc_id, quality) of docs (doc_id, text).

    The sample is bounded by rows: about max_rows different labels, chosen by a hash of doc_id so that
    reruns agree, and of the rows that have such an id about max_rows, chosen by a hash of the text.
    Labels are broadcast after they were counted; features are made on the executors, and numbers of
    max_rows rows reach the driver.  Null labels and ids are left out; an id that is labelled both ways
    counts both ways; repeated labels and equal rows count once.
    """
    share = lambda n: F.lit(int((1 << 20) * min(1.0, max_rows / max(n, 1))))
    known = labels.where("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("double").alias("y"))
    known = cut(known.distinct(), wave(docs.sparkSession))
    sample = cut(known.where(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 20)) < share(known.count())), wave(docs.sparkSession))
    rows = docs.select("doc_id", "text").join(small(sample, sample.count()), "doc_id").select("doc_id", "y", "text", F.xxhash64("text").alias("h"))
    n = rows.select("doc_id", "y", "h").distinct().count()
    rows = rows.where(F.pmod(F.xxhash64("doc_id", "h", F.lit(5)), F.lit(1 << 20)) < share(n))
    rows = rows.groupBy("doc_id", "y", "h").agg(F.first("text").alias("text")).select("y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t.as_py()) for t in b.column(1)], pa.list_(pa.float64()))], ["y", "x"])

    got = rows.mapInArrow(run, "y double, x array<double>").toPandas()
    drop(known, sample)
    x = np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, got["y"].to_numpy()))  # whatever order the rows came in
    return fit(x[order], got["y"].to_numpy(float)[order])


def score(docs: DataFrame, model: Gam, keep: tuple[str, ...] = (), into: str = "score") -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, the columns named in keep, and the score, for every row.

    Empty and null texts have zero features and are scored like any other.  Null and repeated doc_ids
    pass through; an empty table gives no rows; columns not named are ignored.
    """
    names = list(dict.fromkeys(("doc_id", *keep)))
    kept = docs.select(*names, *(() if "text" in names else ("text",)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py()) for t in b["text"]], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array(model.score(x), pa.float64())], [*names, into])

    schema = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in names)
    return kept.mapInArrow(run, f"{schema}, `{into}` double")
