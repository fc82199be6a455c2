"""Token alignment against whole texts encoded at once and walked in Python."""

import hashlib
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftlode.llm import crosstok
from siftlode.llm.crosstok import A_FILE, B_FILE, TOKENIZERS, coders, pieces_of

BOTH = coders(TOKENIZERS, A_FILE, B_FILE)
#: What the two tokenizers treat apart: spaces of all kinds, marks of the other's vocabulary, special tokens.
BITS = ["a", "The", "th", "ing", " ", "  ", "   ", "\n", "\t", " ", "　", "\x1c", " ", "'s", "1", "23", "ß", "é", "中文", "🚖", "▁", "<s>", "<0x41>", "<|endoftext|>", "<unk>", "ﬁ", "\u0000", "é", "...", "#$", "-", "​", "﻿", "X" * 40]


def whole_text(text):
    """(A ids, B ids) of the contract, by encoding the text in one piece."""
    if not text:
        return [], []
    a = BOTH.a.encode(f" {text}", add_special_tokens=False).ids
    b = BOTH.b.encode(text)
    raw = f" {text}".encode()
    return (a, b) if b"".join(BOTH.a_bytes[i] for i in a) == raw == b"".join(BOTH.b_bytes[i] for i in b) else ([], [])


def grouped(a, b):
    """Groups of ids, by walking over both sides."""
    out, i, j, x, y = [], 0, 0, 0, 0
    left, right = [], []
    while i < len(a) or j < len(b):
        if x <= y:
            x += len(BOTH.a_bytes[a[i]])
            left.append(a[i])
            i += 1
        else:
            y += len(BOTH.b_bytes[b[j]])
            right.append(b[j])
            j += 1
        if x == y:
            out.append((left, right))
            left, right = [], []
    assert not left and not right
    return out


def brute(rows):
    groups = [grouped(*whole_text(text)) for _, text in rows]
    linked = [Counter((a, b) for left, right in g for a in left for b in right) for g in groups]
    count = Counter(p for x in linked for p in x)
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    out = []
    for (i, _), g, x in zip(rows, groups, linked, strict=True):
        told = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in g)
        out.append((i, sum(len(left) for left, _ in g), sum(len(r) for _, r in g), len(g), sum(x.values()), sum(n for p, n in x.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in x.items()), hashlib.sha256(told.encode()).hexdigest() if g else ""))
    return out


def order(rows):
    return sorted(map(str, rows))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=14).map("".join) | st.text(max_size=25).filter(lambda t: not any(0xD800 <= ord(c) < 0xE000 for c in t)))
def test_pieces_encode_as_the_whole_text_does(text):
    pieces = pieces_of(text)
    assert " ".join(["", *pieces]) == (f" {text}" if text else "")
    a, b = BOTH.encode(pieces)
    assert [x for ids in a for x in ids] == (BOTH.a.encode(f" {text}", add_special_tokens=False).ids if text else [])
    if "▁" not in text:  # taken for a space, so its text has no tokens, and neither has its piece
        assert [x for ids in b for x in ids] == BOTH.b.encode(text)
    kept, sides = BOTH.tokens(pieces)
    for (ids, begin), one in zip(sides, (a, b), strict=True):
        assert {k: ids[lo:hi].tolist() for k, lo, hi in zip(kept.tolist(), begin, begin[1:], strict=False)} == {k: one[k] for k in kept.tolist()}
    assert sorted(kept.tolist()) == [k for k, (p, x) in enumerate(zip(pieces, b, strict=True)) if b"".join(BOTH.b_bytes[i] for i in x) == f" {p}".encode()]
    whole = all(b"".join(BOTH.b_bytes[i] for i in ids) == f" {p}".encode() for p, ids in zip(pieces, b, strict=True))
    assert (whole and bool(pieces)) == bool(whole_text(text)[0])


def test_documents_against_the_walk(spark):
    texts = [None, "", " ", "  ", "a", "The thing is  \n  here.", "it's 1234 <|endoftext|> <s> naïve", "a▁b", "中文 和 🚖🚖  x", "tab\there and there", "trailing  ", "\n", "The thing is here. " * 3000, "nospaces" * 4000, "1" * 5000, "<0x41>"]
    rows = [*enumerate(texts), (None, "The thing"), (None, None), (3, "The thing"), (3, "The thing")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, piece string, n int").repartition(3)
    got = crosstok.aligned_documents(docs)
    assert order(tuple(r) for r in got.collect()) == order(brute(rows)) and got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_given_documents_in_small_chunks(spark, monkeypatch):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = order(brute([tuple(r) for r in table.collect()]))
    assert order(tuple(r) for r in crosstok.aligned_documents(table).collect()) == want
    monkeypatch.setattr(crosstok, "CHUNK", 20_000)
    monkeypatch.setattr(crosstok, "HELD", 100)
    assert order(tuple(r) for r in crosstok.aligned_documents(table).collect()) == want


def test_assembly_holds_no_object_for_each_entry_of_a_dictionary(monkeypatch):
    """Entries come in any order; documents are added up in batches, and the dictionary stays in Arrow's columns."""
    monkeypatch.setattr(crosstok, "JOINED", 1000, raising=False)
    size, rng = 200_000, np.random.default_rng(3)
    order_ = rng.permutation(size)
    entries = [(int(k), f"{k},{k + 1}|{k % 7}", 2, [-1, -1, 0] if k % 3 else None, k % 5, k) if k != 11 else (11, None, None, None, None, None) for k in order_]
    n, told, n_a, more, n_best, count_sum = (list(x) for x in zip(*entries, strict=True))
    right = pa.table({"n": pa.array(n, pa.int32()), "told": pa.array(told), "n_a": pa.array(n_a, pa.int64()), "more": pa.array(more, pa.list_(pa.int64())), "n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())})
    places = [np.array(x, np.int32) for x in ([], [5, 5, 0], [3, 11], rng.integers(20, size, 5000), [7], [])]
    left = pa.table({"doc_id": pa.array(range(len(places)), pa.int64()), "at": pa.array([crosstok.packed(x) for x in places], pa.binary())})
    want = []
    for i, x in enumerate(x.tolist() for x in places):
        if not x or 11 in x:
            want.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        bent = sum(k % 3 > 0 for k in x)
        said = ";".join(f"{k},{k + 1}|{k % 7}" for k in x)
        want.append((i, 2 * len(x), 2 * len(x) - bent, 2 * len(x) - bent, 2 * len(x), sum(k % 5 for k in x), sum(x), hashlib.sha256(said.encode()).hexdigest()))
    del entries, n, told, n_a, more, n_best, count_sum
    tracemalloc.start()
    got = crosstok._assembled(left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [tuple(r.values()) for r in got.to_pylist()] == want
    assert peak < 80 * size


def test_alignment_by_document_gives_the_groups_of_its_pieces(spark):
    """The relational alignment itself, keyed by documents."""
    rows = [(i, t) for i, t in enumerate(["The thing is here, isn't it?", "中文 naïve 12345 " * 50, "x  y\n z"])]
    kind = "key string, a array<struct<id: int, len: int>>, b array<struct<id: int, len: int>>"
    made = []
    for i, t in rows:
        a, b = whole_text(t)
        made.append((f"d{i}", [(x, len(BOTH.a_bytes[x])) for x in a], [(x, len(BOTH.b_bytes[x])) for x in b]))
    encoded = spark.createDataFrame([*made, ("none", [], [])], kind)
    got = {r.key: [(g.a, g.b) for g in r.groups] for r in crosstok.align(encoded).collect()}
    assert got == {f"d{i}": grouped(*whole_text(t)) for i, t in rows}
    pairs, told = Counter(), {}
    for r in crosstok.linked(crosstok.align(encoded)).collect():
        told[r.key] = (r.n_a, r.n_b, r.n_groups, r.n_links)
        for x in r.links:
            pairs[r.key, x.pair >> 32, x.pair & 0xFFFFFFFF] += x.times
    assert told == {f"d{i}": r[1:5] for i, r in enumerate(brute(rows))}
    assert pairs == Counter((f"d{i}", a, b) for i, t in rows for left, right in grouped(*whole_text(t)) for a in left for b in right)


def test_empty_table_and_foreign_vocabularies(spark, monkeypatch):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert crosstok.aligned_documents(empty).collect() == []
    import sentencepiece

    real = sentencepiece.SentencePieceProcessor.id_to_piece
    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "id_to_piece", lambda self, i: "a▁b" if i == 5 else real(self, i))
    with pytest.raises(ValueError, match="reach over spaces"):
        crosstok.Coders(TOKENIZERS, A_FILE, B_FILE)
