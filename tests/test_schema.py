"""Types of nested fields, and survivors over a stream."""

import json

from pyspark.sql import functions as F

from siftlode.operators import dedupe
from siftlode.plans.testdata import judged
from siftlode.sources import schema
from siftlode.streaming import incremental

SF = "/root/testdata/sf0.001"


def records(spark, *items):
    rows = spark.createDataFrame([(i, json.dumps(x) if x is not ... else None) for i, x in enumerate(items)], "idx long, json string")
    return rows.select("idx", F.parse_json("json").alias("record"), F.lit("x").alias("path"))


def test_issues_at_every_depth(spark):
    df = records(spark, {"bookSourceName": 1, "ruleSearch": {"name": None, "own": 1}}, {"bookSourceType": 1.0, "weight": 2, "enabled": None}, {"ruleToc": [], "ruleContent": {"content": {"a": 1}}}, [], ..., {"bookSourceType": 1.5})
    got = {tuple(r) for r in schema.issues(df).collect()}
    assert got == {(0, "$.bookSourceName", "string", "integer"), (0, "$.ruleSearch.name", "string", "null"), (2, "$.ruleToc", "object", "array"), (2, "$.ruleContent.content", "string", "object"),
                   (3, "$", "object", "array"), (5, "$.bookSourceType", "integer", "number")}


def test_drift_and_depth(spark):
    df = records(spark, {"a": [{"b": 1}, {"b": "x"}, []]}, {"a": None})
    got = {tuple(r) for r in schema.drift(df).collect()}
    assert got == {("$", "object", 2, 0), ("$.a", "array", 1, 0), ("$.a", "null", 1, 1), ("$.a[*]", "object", 2, 0), ("$.a[*]", "array", 1, 0), ("$.a[*].b", "integer", 1, 0), ("$.a[*].b", "string", 1, 0)}
    assert {r.path for r in schema.drift(df, depth=1).collect()} == {"$", "$.a"}
    assert schema.drift(df.where("false")).count() == 0


def test_survivors_over_a_stream_equal_those_of_all_rows(spark, tmp_path):
    rows = judged(spark, SF).drop("cls", "clean")
    rows.write.parquet(str(tmp_path / "all"))
    rows = spark.read.parquet(str(tmp_path / "all")).withColumn("part", F.pmod(F.hash("idx"), F.lit(3)))
    rows = rows.withColumn("url", F.when(F.col("idx") % 3 == 0, F.lit("https://hot.example.com/a")).otherwise(F.col("url")))
    live, seen = {}, []
    changes = []

    def each(batch, number):
        changes.append([tuple(r) for r in batch.collect()])

    for part in range(3):
        rows.where(F.col("part") == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        q = incremental.survivor_changes(stream, "host").writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        for batch in changes:
            for key, change, idx in sorted(batch, key=lambda x: x[1], reverse=True):
                if change == "-":
                    assert live.pop(key) == idx
            for key, change, idx in batch:
                if change == "+":
                    assert key not in live
                    live[key] = idx
        changes.clear()
        seen.append(part)
        want = {r.dedupe_key: r.idx for r in dedupe.survivors(rows.where(F.col("part").isin(seen)), "host").select("dedupe_key", "idx").collect()}
        assert live == want
