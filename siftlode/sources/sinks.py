"""What a run writes: JSON and CSV folders by Spark, and one HTML page of bounded size."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlode.functions.text import csv_audit_field, csv_field

SOURCES_CSV = ("index", "originalName", "cleanedName", "originalGroup", "inferredGroup", "bookSourceType", "bookSourceUrl", "normalizedHost", "availability", "validationReason", "score", "kept", "removedReason", "validationMode", "finalStatus", "firstFailureStage", "failureReasons", "warnings", "durationMs")
#: Rows of each table that the HTML page shows; the CSV files have them all.
HTML_ROWS = 200


def csv_lines(df: DataFrame, columns: dict[str, Column], audit: bool = False) -> DataFrame:
    """One text column `line`; write_csv() puts the header over it."""
    field = csv_audit_field if audit else csv_field
    return df.select(F.concat_ws(",", *[field(c) for c in columns.values()]).alias("line"))


def write_csv(df: DataFrame, columns: dict[str, Column], path: str, audit: bool = False) -> None:
    csv_lines(df, columns, audit).select(F.col("line").alias(",".join(columns))).write.mode("overwrite").option("header", True).option("quote", "").option("escape", "").option("emptyValue", "").option("sep", "\x01").csv(path)


def sources_csv(df: DataFrame) -> dict[str, Column]:
    none = F.lit(None).cast("string")
    has = lambda c, other=none: F.col(c) if c in df.columns else other
    values = (F.col("idx"), F.col("name"), F.col("cleaned_name"), F.col("grp"), F.col("category"), F.coalesce("type", F.lit(-1)), F.col("norm.url"), F.col("norm.normalized_host"), F.col("availability"), F.array_join("structure.reasons", "; "), F.col("score"),
              F.when(F.col("kept"), "yes").otherwise("no"), F.col("removed_reason"), has("batch_mode"), has("batch_status"), has("first_failure_stage"), has("failure_reasons"), has("batch_warnings"), has("duration_ms"))
    return dict(zip(SOURCES_CSV, values, strict=True))


def duplicates_csv() -> dict[str, Column]:
    joined = F.array_join(F.transform("removed_indices", lambda x: x.cast("string")), "; ")
    return {"groupId": F.col("group_id"), "groupKey": F.col("group_key"), "keptIndex": F.col("kept_idx"), "removedIndices": joined, "reason": F.col("reason")}


def with_batch(df: DataFrame, batch: DataFrame | None) -> DataFrame:
    """Reviewed rows with the outcome of their validation, where there was one."""
    if batch is None:
        return df
    b = batch.select(F.col("idx").alias("bidx"), F.col("mode").alias("batch_mode"), F.col("status").alias("batch_status"), "first_failure_stage", F.array_join("reasons", "; ").alias("failure_reasons"), F.array_join("warnings", "; ").alias("batch_warnings"))
    return df.join(b, F.col("idx") == F.col("bidx"), "left").drop("bidx")


def write_array(df: DataFrame, path: str) -> None:
    """(idx, json) as the parts of one JSON array, in the order of idx: put together, they are a file that
    can be imported.  Every part but the last ends in a comma, so no rows pass through the driver."""
    ends = df.agg(F.min("idx").alias("lo"), F.max("idx").alias("hi")).first()  # two numbers
    if ends.lo is None:
        df.sparkSession.range(1).select(F.lit("[]").alias("line")).write.mode("overwrite").text(path)
        return
    line = F.concat(F.when(F.col("idx") == F.lit(ends.lo), "[").otherwise(""), "json", F.when(F.col("idx") == F.lit(ends.hi), "]").otherwise(","))
    df.repartitionByRange("idx").sortWithinPartitions("idx").select(line.alias("line")).write.mode("overwrite").text(path)


def rebuilt(df: DataFrame, meta: bool = False, normalized_url: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(idx, json, columns of keep) of kept records: the raw record with name, group (and url) overwritten, unknown keys kept."""
    raw = F.from_json(F.to_json("raw"), "map<string,variant>")
    text = lambda c: F.parse_json(F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2))
    over = [("bookSourceName", F.coalesce(F.nullif("cleaned_name", F.lit("")), "name", F.lit(""))), ("bookSourceGroup", F.col("final_group"))]
    if normalized_url:
        over.append(("bookSourceUrl", F.when(F.col("norm.url_status") == "VALID_HTTP", F.col("norm.url")).otherwise(F.coalesce("url", F.lit("")))))
    if meta:
        over += [("originalName", F.coalesce("name", F.lit(""))), ("originalUrl", F.coalesce("url", F.lit(""))), ("cleanedName", F.col("cleaned_name")), ("finalCategory", F.col("category"))]
    names = F.array(*[F.lit(n) for n, _ in over])
    fresh = F.map_from_arrays(names, F.array(*[text(v) for _, v in over]))
    if meta:
        fresh = F.map_concat(fresh, F.create_map(F.lit("originalIndex"), F.parse_json(F.col("idx").cast("string"))))
        names = F.array_append(names, F.lit("originalIndex"))
    kept = F.map_filter(raw, lambda k, _: ~F.array_contains(names, k))
    return df.select("idx", F.to_json(F.map_concat(kept, fresh)).alias("json"), *keep)


def html_report(summary: dict, tables: dict[str, DataFrame]) -> str:
    """A page of summary cards, tables of at most HTML_ROWS rows, and a text filter."""
    esc = lambda x: html.escape("" if x is None else str(x))
    cards = "".join(f"<div class=card><b>{esc(v)}</b><span>{esc(k)}</span></div>" for k, v in summary.items())
    parts = []
    for name, df in tables.items():
        rows = df.limit(HTML_ROWS).collect()
        head = "".join(f"<th>{esc(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{esc(v)}</td>" for v in r) + "</tr>" for r in rows)
        parts.append(f"<h2>{esc(name)}</h2><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>")
    data = json.dumps(summary, ensure_ascii=False, default=str).replace("<", "\\u003c")
    script = "document.getElementById('q').oninput=e=>{for(const r of document.querySelectorAll('tbody tr'))r.hidden=!r.textContent.toLowerCase().includes(e.target.value.toLowerCase())}"
    return f"<!doctype html><meta charset=utf-8><title>Catalog report</title><style>.card{{display:inline-block;margin:8px}}table{{border-collapse:collapse}}td,th{{border:1px solid #ccc;padding:2px 6px}}</style>{cards}<input id=q placeholder=filter>{''.join(parts)}<script type=application/json id=data>{data}</script><script>{script}</script>"


def write_text(spark, path: str, text: str) -> None:
    """One file through the cluster's file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
