from collections import Counter, defaultdict

import numpy as np

from siftlode.llm import packing


def best_fit(rows, capacity, per_source):
    bins, out = [], []
    for size, source, cluster in rows:
        fit = [(left, k) for k, (left, s, c) in enumerate(bins) if left >= size and s[source] < per_source and (cluster is None or cluster not in c)]
        least = min((left for left, _ in fit), default=None)
        k = [k for left, k in fit if left == least]
        if not k:
            bins.append([capacity, Counter(), set()])
            k = [len(bins) - 1]
        out.append((size, least))
        b = bins[k[0]]
        b[0] -= size
        b[1][source] += 1
        b[2].add(cluster)
    return len(bins), out


def test_each_piece_goes_to_the_tightest_bin_that_takes_it():
    rng = np.random.default_rng(1)
    for per_source in (1, 3):
        sizes = -np.sort(-rng.integers(0, 100, 300))
        sources = np.where(rng.random(300) < 0.4, 0, rng.integers(0, 6, 300))
        clusters = np.where(rng.random(300) < 0.3, 5, rng.integers(10, 200, 300))
        packer = packing.Packer(100, per_source)
        bins = []
        for s, so, c in zip(sizes.tolist(), sources.tolist(), clusters.tolist(), strict=True):
            fits = [packer.left[b] for b in range(len(packer.left)) if packer.left[b] >= s and bin(packer.sources[b] >> so * per_source & ((1 << per_source) - 1)).count("1") < per_source and not packer.clusters[b] >> c & 1]
            before = list(packer.left)
            b = packer.place(s, so, c)
            assert (b == len(before)) if not fits else before[b] == min(fits)
            bins.append(b)
        by = defaultdict(list)
        for b, s, so, c in zip(bins, sizes, sources, clusters, strict=True):
            by[b].append((s, so, c))
        for rows in by.values():
            assert sum(r[0] for r in rows) <= 100 and max(Counter(r[1] for r in rows).values()) <= per_source and len({r[2] for r in rows}) == len(rows)


def test_whole_table_with_edge_cases(spark):
    rows = [(i, "w " * int(n), f"s{i % 3}", "x") for i, n in enumerate(np.random.default_rng(2).integers(1, 60, 200))]
    rows += [(500, None, None, "x"), (501, "", "s1", "x"), (502, "long " * 1234, "s1", "x"), (None, "Same  text", "s2", "x"), (503, "same text", None, "x"), (503, "same text", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, bin_id string")
    got = packing.pack(df, capacity=100, per_source=2, shard=70).collect()
    assert Counter(r.doc_id for r in got) == Counter([r[0] for r in rows] + [502] * 12)
    by = defaultdict(list)
    for r in got:
        by[r.bin_id].append(r)
    source = {r[0]: r[2] for r in rows}
    for rs in by.values():
        assert sum(r.n_words for r in rs) == rs[0].bin_words <= 100
        at = 0
        for r in sorted(rs, key=lambda r: (r.bin_offset, r.n_words)):
            assert r.bin_offset == at
            at += r.n_words
        assert max(Counter(source[r.doc_id] for r in rs).values()) <= 2 + sum(r.doc_id is None for r in rs)
        assert sum(r.doc_id in (None, 503) for r in rs) <= 1
    long = sorted((r.start_word, r.n_words) for r in got if r.doc_id == 502)
    assert sum(n for _, n in long) == 1234 and [s for s, _ in long] == [100 * k for k in range(13)]
    again = packing.pack(df, capacity=100, per_source=2, shard=70).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
