import re

import numpy as np
import pyarrow as pa

from siftlode.llm import suffixes as S

ROWS = "doc_id long, text string, did string, start_word int"


def words(text):
    return [w.translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))) for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]


def doc(i, text):
    """Order of documents; rows without an id come last and are told apart by their text."""
    return (False, i, "") if i is not None else (True, 0, text or "")


def brute(rows):
    seen = {}
    for i, text in rows:
        w = words(text)
        for s in range(len(w) - 49):
            seen.setdefault(tuple(w[s : s + 50]), set()).add(doc(i, text))
    out = set()
    for i, text in rows:
        w, did = words(text), doc(i, text)
        for removed in (True, False):
            covered = set()
            for s in range(len(w) - 49):
                ids = seen[tuple(w[s : s + 50])]
                if len(ids) > 1 and (min(ids) < did) == removed:
                    covered |= {(s, k) for k in range(s, s + 50)}
            at = sorted({s for s, _ in covered})
            spans = []
            for s in at:
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = s + 50
                else:
                    spans.append([s, s + 50])
            out |= {(i, a, b, removed) for a, b in spans}
    return out


def corpus():
    rng = np.random.default_rng(4)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 900, n)]
    shared = [word(n) for n in (49, 50, 51, 70, 200)]
    rows = []
    for i in range(60):
        parts = word(rng.integers(5, 150))
        for p in shared:
            if rng.random() < 0.3:
                cut = rng.integers(0, 6)
                parts += p[cut:] + word(rng.integers(0, 40))
        rows.append((i, ("\n" if i % 2 else "  ").join(x.upper() if i % 3 else x for x in parts)))
    same = " ".join(word(120))
    rows += [(100, same), (101, same + " tail"), (101, same), (None, same), (None, "ab " * 80), (105, "ab " * 90), (106, None), (107, ""), (108, "short one"), (109, "x y " * 400), (110, "ä " + same)]
    return rows


def test_spans_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], ROWS)
    for run in (S.RUN, 3):  # few words are compared by tasks, most by sums of passages
        got = {(r.doc_id, r.start_word, r.end_word, r.removed) for r in S.repeated_spans(df, run).collect()}
        assert got == brute(rows) and len(got) > 30


def test_neighbours_across_batches_and_partitions():
    rng = np.random.default_rng(6)
    for _ in range(300):
        n = int(rng.integers(1, 40))
        rows = sorted((int(rng.integers(0, 6)), 0, int(rng.integers(0, 3)), 9, i << 17 | int(rng.integers(0, 2))) for i in range(n))
        docs = {}
        for k1, _, did, _, at in rows:
            docs.setdefault(k1, set()).add((did, at & 1))
        want = sorted((did, at) for k1, _, did, _, at in rows if len(docs[k1]) > 1)
        cuts = [0, *sorted(int(c) for c in rng.integers(0, n + 1, rng.integers(0, 3))), n]  # partitions
        found = []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            steps = [lo, *sorted(int(c) for c in rng.integers(lo, hi + 1, rng.integers(0, 4))), hi]
            part = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[a:b]], pa.int64()) for c in (0, 0, 2, 3, 4)], ["k1", "k2", "did", "row", "at"]) for a, b in zip(steps, steps[1:], strict=False)]
            found += [r for b in S._neighbours(iter(part)) for r in b.to_pylist()]
        edge = {}
        for r in found:
            if r["state"] != S.SHARED:
                edge.setdefault(r["key"], []).append(r)
        good = {k for k, v in edge.items() if any(r["state"] == S.SHARED_AT_EDGE for r in v) or len({(r["did"], r["at"] & 1) for r in v}) > 1}
        assert sorted((r["did"], r["at"]) for r in found if r["state"] != S.OPEN or r["key"] in good) == want


def test_words_decide_and_not_their_hashes():
    base = [f"w{i}" for i in range(60)]
    other = base[:40] + ["another"] + base[41:]
    texts = [" ".join(base), " ".join(other), " ".join(base[3:])]
    key = pa.array([1, 1, 1], pa.int64())  # as if the hashes of all suffixes were equal
    t = pa.table({"key": key, "nul": [False] * 3, "did": pa.array([1, 2, 3], pa.int64()), "row": pa.array([1, 2, 3], pa.int64()), "before": pa.array([3, 3, 0], pa.int32()),
                  "words": pa.array([" ".join(x.split()[:53]).encode() for x in texts[:2]] + [" ".join(texts[2].split()[:50]).encode()], pa.binary()), "pos": pa.array([[3], [3], [0]], pa.list_(pa.int32()))})
    got = [(r["did"], m["start_word"], m["end_word"], m["removed"], m["first_id"]) for r in S._match_batch(t).to_pylist() for m in r["found"]]
    assert got == [(1, 3, 53, False, 1), (3, 0, 50, True, 1)]


def test_removed_text_holds_each_passage_once(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], ROWS)
    out = S.remove_repeats(df)
    assert out.columns == df.columns
    left = [(r.doc_id, r.text) for r in out.collect()]
    marks = {(i, t): [] for i, t in rows}
    spans = brute(rows)
    want = []
    for i, t in rows:
        w = [m.group().decode() for m in S.WORD.finditer((t or "").encode())]
        gone = {k for d, a, b, removed in spans if removed and d == i and len(words(t)) >= b and tuple(words(t)[a:a + 50]) for k in range(a, b)} if i not in (101, None) else None
        if gone is None:
            continue
        kept = [x for k, x in enumerate(w) if k not in gone]
        if kept or not gone:
            want.append((i, kept))
    got = [(i, (t or "").split()) for i, t in left if i not in (101, None)]
    assert sorted(got) == sorted(want) and marks


def test_chunked_hashing_is_the_same(monkeypatch):
    text = " ".join(f"wörd{i % 50}" for i in range(500)) + "  \n end"
    whole = S.word_hashes(text)
    monkeypatch.setattr(S, "CHUNK", 37)
    assert (S.word_hashes(text) == whole).all() and len(whole) == 501


def test_empty_table(spark):
    df = spark.createDataFrame([], ROWS)
    assert S.repeated_spans(df).collect() == [] and S.remove_repeats(df).collect() == []


def test_places_of_a_document_are_one_row(spark):
    from pyspark.sql import functions as F

    line = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, " ".join([line] * 100 + [f"end{i}"])) for i in range(3)] + [(2, " ".join([line] * 100 + ["end2"])), (9, "short")], "doc_id long, text string")
    hits = S.shared_suffixes(S._keyed(docs))
    rows, places = hits.count(), hits.select(F.size("at").alias("n")).agg(F.sum("n")).first()[0]
    assert places > 500 and rows * 10 < places
    spans = sorted(map(tuple, S.repeated_spans(docs).collect()))
    assert spans == [(0, 0, 6000, False, 0), (1, 0, 6000, True, 0), (2, 0, 6000, True, 0)]
