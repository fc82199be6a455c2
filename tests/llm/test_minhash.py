import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as P
from siftlode.llm import minhash, simhash


def jaccard(a, b):
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def planted():
    rng = np.random.default_rng(9)
    texts = []
    for n in (6, 12, 30, 80, 200, 600):
        for _ in range(4):
            base = [f"w{x}" for x in rng.integers(0, 5000, n)]
            texts.append(" ".join(base))
            for share in (0.0, 0.005, 0.01, 0.02, 0.03, 0.05):  # words changed: similarities from 1 to under 0.6
                copy = [f"v{i}" if rng.random() < share else w for i, w in enumerate(base)]
                texts.append(" ".join(copy) + (" Tail" if share else ""))
    return texts


def test_similar_is_the_jaccard_of_the_words():
    texts = planted() + ["one", "one two", "A b c d e", "a B c d e"]
    sets = [minhash.shingles(t) for t in texts]
    for i, a in enumerate(texts):
        for j in range(i):
            assert minhash.similar(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j])) == (jaccard(a, texts[j]) >= 0.8)
    assert len(minhash.shingles(None)) == len(minhash.shingles(" ")) == 0


def test_parts_are_linked_as_all_their_pairs_are(monkeypatch):
    rng = np.random.default_rng(12)
    monkeypatch.setattr(minhash, "COLUMNS", 7)
    for _ in range(40):
        rows = []
        for bucket in range(3):
            base = rng.integers(0, 1 << 60, 40)
            for _ in range(int(rng.integers(1, 25))):
                own = rng.random(40) < rng.choice([0.0, 0.05, 0.1, 0.15, 0.4])
                rows.append((bucket, 0, int(rng.integers(0, 12)), sorted({int(x) for x in np.where(own, rng.integers(0, 1 << 60, 40), base)})))
        t = pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "part": pa.array([r[1] for r in rows], pa.int32()), "c": pa.array([r[2] for r in rows], pa.int64()), "shingles": pa.array([r[3] for r in rows], pa.list_(pa.int64()))})
        comp = list(range(12))
        for x, y in zip(*(minhash._links(t)[c].to_pylist() for c in ("a", "b")), strict=True):
            lo, hi = sorted((comp[x], comp[y]))
            comp = [lo if c == hi else c for c in comp]
        want = list(range(12))
        for i, x in enumerate(rows):
            for y in rows[:i]:
                if x[0] == y[0] and len(set(x[3]) & set(y[3])) >= 0.8 * len(set(x[3]) | set(y[3])):
                    lo, hi = sorted((want[x[2]], want[y[2]]))
                    want = [lo if c == hi else c for c in want]
        assert comp == want


def test_bands_reach_pairs_at_the_threshold():
    rng = np.random.default_rng(2)
    met = 0
    for _ in range(500):
        w = [f"w{x}" for x in rng.integers(0, 1 << 40, 94)]
        a, b = w[:85], w[9:94]  # 81 shingles each, 72 in common: 72 / 90
        assert jaccard(" ".join(a), " ".join(b)) == 0.8
        met += bool(set(minhash.bands(" ".join(a))[1].tolist()) & set(minhash.bands(" ".join(b))[1].tolist()))
    assert met >= 499


@pytest.mark.parametrize("block", [minhash.BLOCK, 3])
def test_stage_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash.joined, "__defaults__", (block,))
    rng = np.random.default_rng(3)
    base = [f"c{x}" for x in rng.integers(0, 5000, 100)]  # many copies of one text, most too far from each other
    many = [" ".join(f"v{i}{k}" if rng.random() < 0.02 else w for k, w in enumerate(base)) for i in range(60)]
    texts = planted() + many + [None, "", "one two", "one two"]
    order = np.random.default_rng(1).permutation(len(texts)).tolist()
    texts = [texts[i] for i in order]
    comp = list(range(len(texts)))
    fps = [simhash.fingerprint(t) for t in texts]
    missed = 0  # similar pairs that three bits do not reach
    for i, a in enumerate(texts):
        for j in range(i):
            like = bool(a and texts[j]) and jaccard(a, texts[j]) >= 0.8
            close = (fps[i] ^ fps[j]).bit_count() <= 3
            missed += like and not close
            if (like or close) and comp[i] != comp[j]:
                lo, hi = sorted((comp[i], comp[j]))
                comp = [lo if c == hi else c for c in comp]
    assert missed > 20
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = P.drop_near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(comp))


def test_long_texts_of_one_bucket_are_compared_in_parts_bounded_by_bytes(spark, monkeypatch):
    """Texts alike in pairs: all links are found, whatever the size of a part."""
    import random

    rng = random.Random(4)
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(400)) for _ in range(600)) for _ in range(12)]
    rows = []
    for k, text in enumerate(base):
        words = text.split(" ")
        words[300:303] = ["x", "y", "z"]
        rows += [(2 * k, text), (2 * k + 1, " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 2000)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    assert {r.doc_id for r in minhash.keep_first(docs).collect()} == set(range(0, 24, 2))
