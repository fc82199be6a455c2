import re

import numpy as np
import xxhash

from siftlode.llm import simhash


def plain(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(fps):
    n = len(fps)
    comp = list(range(n))
    for i in range(n):
        for j in range(n):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and comp[i] != comp[j]:
                lo, hi = sorted((comp[i], comp[j]))
                comp = [lo if c == hi else c for c in comp]
    return comp


TEXTS = [None, "", "  ", "One", "one  TWO", "a b c d e f g", "A b\tc d\ne f g", "a b c d e f h", "ß Ä ä " * 400, "x y z\x1cq r", "l " * 3000]


def test_fingerprints_follow_the_definition():
    for t in TEXTS:
        assert simhash.fingerprint(t) == plain(t)


def test_chunks_do_not_change_a_fingerprint(monkeypatch):
    text = " ".join(str(i * i) for i in range(1000))
    monkeypatch.setattr(simhash, "CHUNK", 17)
    assert simhash.fingerprint(text) == plain(text)


def test_components_against_all_pairs(spark):
    rows = [(i + 10, t, "x") for i, t in enumerate(TEXTS + TEXTS[3:6])]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id string")).collect()}
    fps = [plain(t) for _, t, _ in rows]
    for (i, _, _), fp, g in zip(rows, fps, groups(fps), strict=True):
        assert got[i] == (f"{fp:016x}", g + 10)


def test_links_within_three_bits_are_all_found(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 12, np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(40):
            x = int(b)
            for bit in rng.choice(64, rng.integers(1, 4), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    want = {f: fps[g] for f, g in zip(fps, groups(fps), strict=True)}
    for block in (simhash.BLOCK, 7):
        comp = simhash.components(simhash.fingerprint_links(df, block=block))
        got = {r.id % (1 << 64): r.component % (1 << 64) for r in comp.collect()}
        by = {}
        for f in fps:
            by.setdefault(got.get(f, f), set()).add(f)
        wanted = {}
        for f in fps:
            wanted.setdefault(want[f], set()).add(f)
        assert sorted(map(sorted, by.values())) == sorted(map(sorted, wanted.values()))


def test_long_runs_lose_no_link():
    rng = np.random.default_rng(5)
    base = np.uint64(rng.integers(0, 1 << 63))
    fp = np.unique(np.array([base ^ np.uint64(sum(1 << int(b) for b in rng.choice(np.arange(32, 64), rng.integers(0, 9), replace=False))) for _ in range(900)], np.uint64))
    lab = simhash._connected(fp, np.zeros(len(fp), np.int64), np.zeros(len(fp), np.int64), 3)
    chains = simhash._chain_masks(0, 3)
    want = np.arange(len(fp))
    for a in range(len(fp)):
        x = fp[a] ^ fp
        near = np.all([np.bitwise_count(x & m) <= most for m, most in chains], axis=0)
        ids = np.unique(want[near])
        want[np.isin(want, ids)] = ids.min()
    assert (lab == want).all() and len(np.unique(lab)) > 5


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).collect() == []
    some = spark.createDataFrame([(None, "a b c d"), (None, "q r s t u")], "doc_id long, text string")
    assert {r.component_id for r in simhash.near_duplicates(some).collect()} == {None}


def test_buckets_of_two_starts_stay_apart(spark):
    rng = np.random.default_rng(8)
    # segment 1 and the low half of segment 2 are zero, as are the same bits one start before in the first row
    x = 5 | 0x0100 << 32 | 0x4421 << 48
    y = x ^ (1 << 3 | 1 << 7 | 1 << 45)  # three bits apart, within budget from start 1 only
    fill = {int(a) | int(b) << 40 | int(c) << 48 for a, b, c in zip(rng.integers(1, 1 << 16, 300), rng.integers(0, 1 << 8, 300), rng.integers(1, 1 << 15, 300), strict=True)}
    fps = sorted({1 << 24, x, y} | fill)
    want = {f: fps[g] for f, g in zip(fps, groups(fps), strict=True)}
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    got = {r.id % (1 << 64): r.component % (1 << 64) for r in simhash.components(simhash.fingerprint_links(df)).collect()}
    assert want[x] == want[y] and got.get(x, x) == got.get(y, y)
