"""Shared pieces of the training-data operators: lineage cuts, bounded broadcasts, components.

Every helper is a DataFrame plan; the driver only ever sees row counts and other single numbers.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows a table may have for broadcast() to be put on it.
BROADCAST_ROWS = 50_000

_own_dir: str | None = None
#: Tables that stand, with the session that wrote them; what is left goes when the driver exits.
_made: dict[str, SparkSession] = {}
#: The list of the innermost swept() of this thread.
_owner: ContextVar[list[str] | None] = ContextVar("owner", default=None)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; one of our own only where none is set and all
    runs on this machine (tests).  Elsewhere executors would write where nobody reads: an error."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="siftlode-")
    return _own_dir


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Makes Spark remove the shuffle files of a query at its end, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Lets an aggregation of rows that are sorted by its keys run over them as they come, once, without a hash table.
SORTED_SUMS = {"spark.sql.execution.replaceHashWithSortAgg": "true"}


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def cut(df: DataFrame, files: int | None = None, codec: str | None = None, settings: dict[str, str] | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and a lost
    executor costs no recomputation.  The table is removed by drop() or when the driver exits.

    files: at most so many files, by joining partitions of the last stage; give it where that stage
    follows a shuffle, so that many small partitions do not become as many small files.  codec: of the
    files, where Spark's default is too large.  settings: of the session while df is planned and written."""
    spark = df.sparkSession
    if files:
        df = df.coalesce(files)
    path = f"{scratch_dir(spark)}/siftlode/{uuid.uuid4().hex}"
    with _set(spark, {_CLEANUP: "true", **(settings or {})}):
        df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._siftlode_path = path
    if not _made:
        atexit.register(_at_exit)
    _made[path] = spark
    if (mine := _owner.get()) is not None:
        mine.append(path)
    return out


def _at_exit() -> None:
    for path, spark in list(_made.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session is gone; so is whatever it could delete with
            pass


def drop(*tables: DataFrame | None) -> None:
    """Remove tables written by cut() which no plan needs any more."""
    for t in tables:
        path = getattr(t, "_siftlode_path", None)
        if path and _made.pop(path, None):
            _delete(t.sparkSession, path)


@contextmanager
def swept(spark: SparkSession):
    """Removes, at its end, the tables that this thread made meanwhile, but for those given to what it yields: for a
    caller that has written its result, so that nothing lies about until the driver ends.  It does so after an
    error too; what other threads make is theirs, and what is kept belongs to the swept() around it, if any."""
    mine: list[str] = []
    kept: list[DataFrame] = []
    token = _owner.set(mine)
    try:
        yield kept.append
    finally:
        _owner.reset(token)
        stay = {t._siftlode_path for t in kept}
        for path in mine:
            if path not in stay and _made.pop(path, None):
                _delete(spark, path)
        if (outer := _owner.get()) is not None:
            outer += stay


def wave(spark: SparkSession) -> int:
    """Two tasks a core of the cluster: files enough for a table of a bounded number of rows."""
    return 2 * spark.sparkContext.defaultParallelism


def files_for(table: DataFrame, mb: int = 4) -> int:
    """Files for what is made of a written table by a shuffle: one for every mb of it, a wave at least."""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(1 << 20, max(wave(table.sparkSession), -(-size // (mb << 20))))


def small(df: DataFrame, rows: int) -> DataFrame:
    """broadcast() where the counted rows allow it; otherwise Spark shuffles both sides."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def whole_runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Batches of rows sorted by keys -> tables in which no run of equal keys is cut."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        changes = np.flatnonzero(np.logical_or.reduce([np.diff(b[k].to_numpy()) != 0 for k in keys]))
        if held and any(b[k][0] != held[-1][k][-1] for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        end = int(changes[-1]) + 1 if len(changes) else 0
        if end:
            yield pa.Table.from_batches([*held, b.slice(0, end)])
            held = []
        held.append(b.slice(end))
    if held:
        yield pa.Table.from_batches(held)


def in_blocks(rows: DataFrame, bucket: str, id_: str, block: int, files: int, weight: Column | None = None) -> DataFrame:
    """rows -> + block int, part int, two boolean, with rows of heavy buckets repeated: each pair of rows of a
    bucket is in some part of it, and no part has more than about two blocks.  two: the part is for pairs
    of rows of different blocks; those of one block have a part of their own.

    A bucket of more than `block` rows (or of more than `block` of their weight) is cut into blocks by a hash
    of id_, and every pair of blocks is a part."""
    sizes = rows.groupBy(F.col(bucket).alias("hb")).agg(F.sum(F.lit(1.0) if weight is None else weight).alias("size")).where(F.col("size") > block)
    heavy = cut(sizes.select("hb", F.ceil(F.col("size") / block).cast("int").alias("blocks")), files)
    n = heavy.count()
    if not n:
        drop(heavy)
        return rows.select("*", F.lit(0).alias("block"), F.lit(0).alias("part"), F.lit(False).alias("two"))
    names = rows.columns
    rows = rows.join(small(heavy, n), rows[bucket] == heavy.hb, "left")
    mine = F.pmod(F.xxhash64(id_, F.lit(7)), F.col("blocks")).cast("int")
    one = lambda part, two: F.struct(part.cast("int").alias("part"), two.alias("two"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: one(F.least(x, mine) * F.col("blocks") + F.greatest(x, mine), x != mine))
    return rows.select(*names, F.coalesce(mine, F.lit(0)).alias("block"), F.inline(F.when(F.col("blocks").isNull(), F.array(one(F.lit(0), F.lit(False)))).otherwise(pairs)))


def hook(lab: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (each the smallest index of its set) after the sets of the links i-j are joined."""
    while len(i):
        a, b = lab[i], lab[j]
        open_ = a != b
        if not open_.any():
            break
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(lab, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = lab[lab]
            if (up == lab).all():
                break
            lab = up
    return lab


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long) -> (id long, component long).

    component is the smallest id reachable.  Self-links, repeats and nulls are ignored; ids without
    a link to another id do not appear.  Each round hooks every vertex to its smallest neighbour,
    halves the pointer paths until they are flat, and contracts the edges to the roots, so rounds
    and jumps are logarithmic.  Every step is an aggregation with partial sums or an equi-join whose
    hot side the adaptive planner can split; no vertex's neighbours are ever gathered.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("r")).where("a <> b").distinct(), files_for(edges))
    most = 1 + e.count() // 250_000  # later tables have no more rows than this one
    labels = None
    while not e.isEmpty():
        p = cut(e.groupBy("v").agg(F.min("r").alias("p")), most)
        while True:
            y = p.select(F.col("v").alias("yv"), F.col("p").alias("yp"))
            jumped = cut(p.join(y, p.p == y.yv, "left").select("v", F.coalesce("yp", "p").alias("p"), F.col("yp").isNotNull().alias("moved")), most)
            drop(p)
            p = jumped
            if p.where("moved").isEmpty():
                break
        pv = p.select(F.col("v").alias("id"), F.col("p").alias("to"))
        if labels is None:
            new = cut(pv.select("id", F.col("to").alias("component")), most)
        else:
            up = pv.select(F.col("id").alias("was"), "to")
            moved = labels.join(up, labels.component == up.was, "left").select("id", F.coalesce("to", "component").alias("component"))
            new = cut(moved.unionByName(pv.select("id", F.col("to").alias("component"))).groupBy("id").agg(F.min("component").alias("component")), most)
        left = pv.select(F.col("id").alias("lv"), F.col("to").alias("tv"))
        right = pv.select(F.col("id").alias("lr"), F.col("to").alias("tr"))
        x = e.join(left, e.v == left.lv).join(right, e.r == right.lr, "left").select("tv", F.coalesce("tr", "r").alias("tr"))
        nxt = cut(x.where("tv <> tr").select(F.greatest("tv", "tr").alias("v"), F.least("tv", "tr").alias("r")).distinct(), most)
        drop(e, p, labels)
        e, labels = nxt, new
    drop(e)
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).where(F.lit(False))
    roots = labels.select(F.col("component").alias("id"), "component").distinct()
    return labels.unionByName(roots).groupBy("id").agg(F.min("component").alias("component"))
