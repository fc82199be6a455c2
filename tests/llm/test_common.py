import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftlode.llm import common


def brute(edges):
    comp = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(comp[a], comp[b])
            if comp[a] != m or comp[b] != m:
                comp[a] = comp[b] = m
                changed = True
    return comp


def test_components(spark):
    rng = np.random.default_rng(1)
    chain = [(i, i + 1) for i in range(200, 260)]
    star = [(999, i) for i in range(300, 340)] + [(1, 999)]
    noise = [(int(a), int(b)) for a, b in rng.integers(400, 520, (70, 2)) if a != b]
    edges = chain + star + noise + chain[:3]
    df = spark.createDataFrame(edges + [(5, 5), (None, 7)], "a long, b long")
    got = {r.id: r.component for r in common.components(df).collect()}
    assert got == brute(edges)
    assert common.components(df.where(F.lit(False))).collect() == []


def test_tables_are_written_where_the_cluster_says(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "scratch_dir", lambda _: f"file://{tmp_path}")
    t = common.cut(spark.range(5).repartition(7), 2)
    assert t.count() == 5 and 0 < len(list(tmp_path.glob("siftlode/*/*.parquet"))) <= 2
    common.drop(t)
    assert not list(tmp_path.glob("siftlode/*"))
    early = common.cut(spark.range(2))
    with common.swept(spark) as keep:
        tables = [common.cut(spark.range(3)) for _ in range(3)]
        keep(tables[1])
    assert len(list(tmp_path.glob("siftlode/*"))) == 2 and tables[1].count() == 3 and early.count() == 2


def test_the_folder_is_the_sessions_own_only_where_none_is_named():
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: "hdfs:///shared" if key == "spark.checkpoint.dir" else default)

    assert common.scratch_dir(Session) == "hdfs:///shared"


def test_a_cluster_without_a_shared_folder_is_refused():
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch_dir(Session)


def test_runs_are_whole():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a = np.sort(rng.integers(0, 9, 40))
        b = np.sort(rng.integers(0, 3, 40))
        t = pa.table({"a": a, "b": b}).sort_by([("a", "ascending"), ("b", "ascending")])
        parts = list(common.whole_runs(iter([x for n in (7,) for x in t.to_batches(max_chunksize=n)]), ("a", "b")))
        assert pa.concat_tables(parts).equals(t.combine_chunks()) or pa.concat_tables(parts).to_pylist() == t.to_pylist()
        ends = [(p["a"][-1].as_py(), p["b"][-1].as_py()) for p in parts]
        starts = [(p["a"][0].as_py(), p["b"][0].as_py()) for p in parts]
        assert all(x != y for x, y in zip(ends, starts[1:]))


def test_blocks_bring_each_pair_of_a_bucket_together(spark):
    rows = spark.createDataFrame([(b, i) for b, n in ((1, 40), (2, 3)) for i in range(n)], "bucket long, id long")
    got = {}
    for r in common.in_blocks(rows, "bucket", "id", 10, 2).collect():
        got.setdefault((r.bucket, r.part), set()).add(r.id)
    for b, n in ((1, 40), (2, 3)):
        for i in range(n):
            for j in range(i):
                assert any(k == b and {i, j} <= v for (k, _), v in got.items())
    assert len([k for k in got if k[0] == 1]) == 10


def test_swept_takes_only_what_its_own_thread_made(spark):
    import threading

    from siftlode.llm.common import cut, swept

    made, open_, done = [], threading.Event(), threading.Event()

    def other():
        open_.wait(20)
        made.append(cut(spark.range(7)))
        done.set()

    t = threading.Thread(target=other)
    t.start()
    with swept(spark) as outer_keep:
        with swept(spark) as keep:
            inner, kept = cut(spark.range(3)), cut(spark.range(5))
            keep(kept)
            open_.set()
            done.wait(20)
        assert kept.count() == 5 and made[0].count() == 7
        with pytest.raises(Exception, match="NOT_EXIST|does not exist"):
            inner.count()
        last = cut(spark.range(2))
        outer_keep(last)
    t.join()
    assert made[0].count() == 7 and last.count() == 2
    with pytest.raises(Exception, match="NOT_EXIST|does not exist"):
        kept.count()


def test_swept_cleans_up_after_an_error(spark):
    from siftlode.llm.common import cut, swept

    held = []
    with pytest.raises(RuntimeError):
        with swept(spark):
            held.append(cut(spark.range(3)))
            raise RuntimeError
    with pytest.raises(Exception, match="NOT_EXIST|does not exist"):
        held[0].count()


def test_blocks_follow_weights(spark):
    from siftlode.llm.common import in_blocks

    rows = spark.createDataFrame([(1, i, 100) for i in range(40)] + [(2, 100 + i, 1) for i in range(40)], "b long, i long, n long")
    got = in_blocks(rows, "b", "i", 500, 4, F.col("n")).collect()
    parts = {}
    for r in got:
        parts.setdefault((r.b, r.part), set()).add(r.i)
    heavy = [x for (b, _), x in parts.items() if b == 1]
    assert len(parts) > 9 and {p for b, p in parts if b == 2} == {0} and max(map(len, heavy)) < 30
    assert {(i, j) for x in heavy for i in x for j in x} == {(i, j) for i in range(40) for j in range(40)}
