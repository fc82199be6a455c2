"""Plan shaping."""

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def barrier(df: DataFrame) -> DataFrame:
    """df, past which the optimizer moves no filter.

    A filter that is pushed through a chain of derived columns takes each column's whole expression
    along, once for every use; over long chains that grows without bound.  Scan filters are written
    before such a chain anyway.  The row id is a counter in generated code and costs nothing else.
    """
    return df.withColumn("__at", F.monotonically_increasing_id()).where("__at >= 0").drop("__at")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt out by columns over all cores: for rows that are small but dear to work on, which Spark would
    leave in one task where their file is small."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)


def opaque(df: DataFrame, column: str) -> DataFrame:
    """df with a column that is to be a join key, cut off from what it is made of.

    Before a join the optimizer writes the key out in terms of the scan's columns, looking for filters;
    over long chains of expressions that takes minutes (measured: 100 s for one level of dedupe).  It
    does not look into what a generator makes, here one row of each."""
    return df.withColumn(column, F.explode(F.array(F.col(column))))


def numbered(df: DataFrame, *by: str | Column, into: str = "n") -> DataFrame:
    """df + its place, from 0, in the order of `by`, which must be total.

    Rows are dealt out by ranges and sorted there; only one count for each partition is added up over
    all of them.  The dealt rows are persisted, so that both uses see the same ranges, until release()."""
    at, mask = F.col("__at"), F.lit((1 << 33) - 1)
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()).persist(StorageLevel.MEMORY_AND_DISK)
    counts = dealt.groupBy(F.shiftright(at, 33).alias("__p")).agg(F.count("*").alias("__rows"))
    before = F.coalesce(F.sum("__rows").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__p", before.alias("__before"))  # a row for each partition
    out = dealt.join(F.broadcast(starts), F.shiftright(at, 33) == F.col("__p")).withColumn(into, F.col("__before") + at.bitwiseAND(mask)).drop("__at", "__p", "__before")
    return holding(out, dealt)


def holding(df: DataFrame, *of: DataFrame) -> DataFrame:
    """df, which keeps what `of` are, or hold, persisted: release(df) lets it go."""
    df._held = [x for o in of for x in getattr(o, "_held", [o])]
    return df


def release(df: DataFrame) -> None:
    for x in getattr(df, "_held", []):
        x.unpersist()
