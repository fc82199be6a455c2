"""Catalogs that arrive in pieces, as Structured Streaming over the same expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siftlode.operators import dedupe, urls


def landing(spark: SparkSession, folder: str, schema: str, files: int = 1) -> DataFrame:
    """JSON lines that appear in a folder, a few files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)


def first_of_host(stream: DataFrame, ts: str = "ts", url: str = "url", delay: str = "1 hour") -> DataFrame:
    """The first record of each site within the watermark; state is bounded by it."""
    df = urls.with_url(stream).withColumn("host_key", F.col("norm.normalized_host"))
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["host_key"])


#: What rows of a key are ordered by; see dedupe.survivor_order.
ORDER = ("score", "availability", "respond_time", "last_update_time", "weight", "rules", "idx")
_KINDS = ("double", "int", "double", "long", "double", "int", "long")


def survivor_changes(stream: DataFrame, level: str) -> DataFrame:
    """Reviewed rows that arrive -> dedupe_key, change, idx: `+` for a row that becomes the best of its key, `-` for the one it replaces.

    After each micro-batch the rows put in and not taken back are dedupe.survivors of all rows so far, in
    whichever order they came.  The state is one row for each key.  Rows without a key are keys of their own and
    hold no state.  Before the shuffle each Arrow batch is reduced to the best row of each of its keys, so a key
    that most rows share sends few of them.  Written in update mode."""
    columns = [f"o{i}" for i in range(len(ORDER))]
    schema = ", ".join(["dedupe_key string", *(f"{c} {t}" for c, t in zip(columns, _KINDS, strict=True))])
    place = dedupe.survivor_order()
    # dedupe.keyed without its barriers, which no stream has; nothing filters by the key here
    rows = stream.withColumn("__candidate", urls.strip_decorations(F.col("url"))).select(dedupe.key(level).alias("dedupe_key"), place.alias("place"))
    rows = rows.select(F.coalesce("dedupe_key", F.concat(F.lit("\x00"), F.col("place.idx").cast("string"))).alias("dedupe_key"), *(F.col(f"place.{f}").cast(t).alias(c) for f, c, t in zip(ORDER, columns, _KINDS, strict=True)))

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.sort_values(columns, kind="stable").drop_duplicates("dedupe_key")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = tuple(state.get) if state.exists else None
        new = min((t for b in batches for t in b[columns].sort_values(columns).head(1).itertuples(index=False, name=None)))
        if old is not None and old <= new:
            return
        if not key[0].startswith("\x00"):
            state.update(new)
        yield pd.DataFrame([(key[0], "+", int(new[-1])), *([(key[0], "-", int(old[-1]))] if old else [])], columns=["dedupe_key", "change", "idx"])

    kept = ", ".join(f"{c} {t}" for c, t in zip(columns, _KINDS, strict=True))
    return rows.mapInPandas(reduce, schema).groupBy("dedupe_key").applyInPandasWithState(step, "dedupe_key string, change string, idx long", kept, "update", GroupStateTimeout.NoTimeout)


def progress(stream: DataFrame, ts: str = "ts", window: str = "5 minutes", delay: str = "10 minutes", key: str = "event_type") -> DataFrame:
    """Counts by window and key, closed by the watermark."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, window).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")


def percent(step_percent: int) -> int:
    """Progress shown while the steps of a job run: the second half, never 100."""
    return min(99, int(50 + 0.4 * step_percent))


def run_batches(stream: DataFrame, each, checkpoint: str):
    """each(batch DataFrame, number) for whatever has arrived, then stop; exactly once by the checkpoint."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
