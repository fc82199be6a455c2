import numpy as np

from siftlode.llm import embeddings as E


def brute(vecs, threshold=0.95):
    ok = [v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in vecs]
    n, links, comp = len(vecs), [0] * len(vecs), [i for i, _ in vecs]
    for a in range(n):
        for b in range(n):
            if a == b or not (ok[a] and ok[b]) or len(vecs[a][1]) != len(vecs[b][1]):
                continue
            x, y = (np.asarray(vecs[k][1], np.float32).astype(float) for k in (a, b))
            if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[a] += 1
                lo, hi = sorted((comp[a], comp[b]))
                comp = [lo if c == hi else c for c in comp]
    return {i: (k, c, i == c) for (i, _), k, c in zip(vecs, links, comp, strict=True)}


def rows_for(rng, n=150, dim=16):
    base = rng.standard_normal((n, dim))
    vecs = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    for i in range(60):
        v = base[i % 7] + rng.standard_normal(dim) * rng.choice([0.02, 0.1, 0.2])
        vecs.append((1000 + i, [float(x) for x in v]))
    vecs += [(2000 + i, vecs[3][1]) for i in range(9)]
    vecs += [(3000, None), (3001, []), (3002, [0.0] * dim), (3003, [None] + [1.0] * (dim - 1)), (3004, [float("nan")] * dim), (3005, [float("inf")] * dim), (3006, vecs[0][1][:8]), (3007, vecs[0][1][:8])]
    return vecs


def run(spark, vecs, **k):
    df = spark.createDataFrame([(i, v, "x") for i, v in vecs], "vec_id long, embedding array<float>, component_id string")
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df, **k).collect()}


def test_against_all_pairs(spark):
    vecs = rows_for(np.random.default_rng(1))
    assert run(spark, vecs, recall=0.999999) == brute(vecs)


def test_blocks_of_a_large_bucket_count_each_pair_once(spark, monkeypatch):
    vecs = rows_for(np.random.default_rng(2))
    monkeypatch.setattr(E.link_vectors, "__defaults__", (5,))
    assert run(spark, vecs, how=E.Hashing(1, 30, width=6.0)) == brute(vecs)


def test_planned_hashing_keeps_its_recall():
    rng = np.random.default_rng(3)
    how = E.Hashing.planned(50_000, 0.95)
    a = rng.standard_normal((3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((3000, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * b
    assert (how.keys(a) == how.keys(b)).any(axis=1).mean() >= 0.95


def test_sketches_of_links_are_near():
    rng = np.random.default_rng(6)
    how = E.Hashing(4, 2)
    a = rng.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((4000, 64))
    c = b / np.linalg.norm(b, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * b
    apart = lambda x, y: np.bitwise_count((how.sketch(x) ^ how.sketch(y)).view(np.uint64)).sum(axis=1)
    assert (apart(a, b) <= E.far(0.95)).all() and (apart(a, c) > E.far(0.95)).mean() > 0.99 and 30 < E.far(0.95) < 50


def test_whole_pipeline_of_the_operator_at_its_defaults(spark):
    """As the query runs it, with copies at and near the threshold: most links are found, none below it."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((1500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.standard_normal((500, 64))
    other -= (other * base[:500]).sum(1, keepdims=True) * base[:500]
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cos = rng.uniform(0.93, 0.999, 500)[:, None]
    near = cos * base[:500] + np.sqrt(1 - cos**2) * other
    vecs = [(i, [float(x) for x in v]) for i, v in enumerate(np.r_[base, near])]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in E.near_duplicates(df).collect()}
    links = (np.r_[base, near] @ np.r_[base, near].T >= 0.95).sum(axis=1) - 1
    assert all(got[i] <= n for i, n in enumerate(links)) and sum(got.values()) >= 0.97 * links.sum() > 600


def test_doubles_are_not_rounded(spark):
    df = spark.createDataFrame([(1, [1e300, 1.0]), (2, [1e300, 2.0]), (3, [1e-300, 0.0]), (4, [0.0, 1e-320])], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_duplicates(df, how=E.Hashing(1, 20)).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}


def test_empty_table(spark):
    assert run(spark, []) == {}
