"""Catalog records: open-schema JSON arrays as flat columns that keep every unknown key."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Flat column -> (path in the record, type).
FIELDS = {
    "name": ("bookSourceName", "string"), "url": ("bookSourceUrl", "string"), "grp": ("bookSourceGroup", "string"), "type": ("bookSourceType", "int"),
    "comment": ("bookSourceComment", "string"), "book_url_pattern": ("bookUrlPattern", "string"), "search_url": ("searchUrl", "string"), "explore_url": ("exploreUrl", "string"),
    "header": ("header", "string"), "login_url": ("loginUrl", "string"), "login_ui": ("loginUi", "string"), "login_check_js": ("loginCheckJs", "string"), "js_lib": ("jsLib", "string"),
    "enabled": ("enabled", "boolean"), "enabled_explore": ("enabledExplore", "boolean"), "respond_time": ("respondTime", "double"), "last_update_time": ("lastUpdateTime", "long"), "weight": ("weight", "double"),
    "rs_list": ("ruleSearch.bookList", "string"), "rs_name": ("ruleSearch.name", "string"), "rs_author": ("ruleSearch.author", "string"), "rs_url": ("ruleSearch.bookUrl", "string"), "rs_check_key": ("ruleSearch.checkKeyWord", "string"),
    "bi_name": ("ruleBookInfo.name", "string"), "bi_author": ("ruleBookInfo.author", "string"), "bi_intro": ("ruleBookInfo.intro", "string"), "bi_toc_url": ("ruleBookInfo.tocUrl", "string"),
    "toc_list": ("ruleToc.chapterList", "string"), "toc_name": ("ruleToc.chapterName", "string"), "toc_url": ("ruleToc.chapterUrl", "string"),
    "ct_content": ("ruleContent.content", "string"), "ct_image": ("ruleContent.imageStyle", "string"), "ct_regex": ("ruleContent.sourceRegex", "string"),
}
BUNDLES = {"rs_keys": "ruleSearch", "bi_keys": "ruleBookInfo", "toc_keys": "ruleToc", "ct_keys": "ruleContent"}
STRINGS = tuple(c for c, (_, kind) in FIELDS.items() if kind == "string")


def flatten(records: DataFrame, idx: str = "idx", record: str = "record") -> DataFrame:
    """(idx, record variant) -> idx, flat columns, issues (fields of another type), raw (the record)."""
    v = F.col(record)
    cols = [F.col(idx).cast("long").alias("idx")]
    cols += [F.try_variant_get(v, f"$.{path}", kind).alias(c) for c, (path, kind) in FIELDS.items()]
    cols += [F.size(F.map_keys(F.try_variant_get(v, f"$.{path}", "map<string,variant>"))).alias(c) for c, path in BUNDLES.items()]
    cols = [F.when(c_ >= 0, c_).alias(name) if name in BUNDLES else c_ for c_, name in zip(cols, ["idx", *FIELDS, *BUNDLES], strict=True)]
    issues = F.array_compact(F.array(*[
        F.when(F.try_variant_get(v, f"$.{path}", "variant").isNotNull() & ~F.is_variant_null(F.try_variant_get(v, f"$.{path}", "variant")) & F.try_variant_get(v, f"$.{path}", kind).isNull(), F.lit(f"{path}: not {kind}"))
        for path, kind in FIELDS.values()], *[
        F.when(F.try_variant_get(v, f"$.{path}", "variant").isNotNull() & ~F.is_variant_null(F.try_variant_get(v, f"$.{path}", "variant")) & F.try_variant_get(v, f"$.{path}", "map<string,variant>").isNull(), F.lit(f"{path}: not an object"))
        for path in BUNDLES.values()]))
    return records.select(*cols, issues.alias("issues"), v.alias("raw"))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file whose root is an array of records; anything else raises.  idx is the place in it."""
    text = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    items = F.try_variant_get("v", "$", "array<variant>")
    checked = F.when(items.isNotNull(), items).otherwise(F.raise_error(F.lit("the root of a catalog must be an array")))
    return flatten(text.select(F.posexplode(checked).alias("idx", "record")))


def from_lines(lines: DataFrame, text: str = "value", idx: str = "idx") -> DataFrame:
    """One record a row, for catalogs too large for one document."""
    return flatten(lines.select(F.col(idx).alias("idx"), F.parse_json(text).alias("record")))


#: Bytes of an uploaded catalog at most, and uploads that are kept.
UPLOAD_BYTES, UPLOADS = 50 << 20, 50


def landed(spark: SparkSession, folder: str, most: int = UPLOAD_BYTES, newest: int = UPLOADS) -> DataFrame:
    """Files of a landing folder -> path, name (made safe), bytes, modified, verdict: accepted, not_json (by
    suffix), too_large, unreadable (not a JSON array), or evicted, where `newest` later ones were accepted.

    Only files that may pass by suffix and size are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.substring(F.regexp_replace(F.element_at(F.split("path", "/"), -1), "[^a-zA-Z0-9._-]", "_"), 1, 128)
    fits = F.lower("path").endswith(".json") & (F.col("length") <= most)
    array = F.try_variant_get(F.try_parse_json(F.decode(F.when(fits, F.col("content")), "utf-8")), "$", "array<variant>").isNotNull()
    verdict = F.when(~F.lower("path").endswith(".json"), "not_json").when(F.col("length") > most, "too_large").when(~array, "unreadable").otherwise("accepted")
    rows = files.select("path", name.alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), verdict.alias("verdict"))
    last = rows.where("verdict = 'accepted'").orderBy(F.desc("modified"), "path").limit(newest).select(F.col("path").alias("last"))
    return rows.join(last, F.col("path") == F.col("last"), "left").withColumn("verdict", F.when((F.col("verdict") == "accepted") & F.col("last").isNull(), "evicted").otherwise(F.col("verdict"))).drop("last")


def preview(df: DataFrame, limit: int = 5) -> tuple[DataFrame, int]:
    """The first rows by idx, 1 to 50 of them, and the number of all."""
    return df.orderBy("idx").limit(min(50, max(1, limit))), df.count()


def page_store(df: DataFrame, url: str = "url", body: str = "html", status: Column | None = None) -> DataFrame:
    """url, status, content_type, body: what a fetcher would have seen."""
    kind = F.when(F.ltrim(body).rlike(r"^[\[{]"), "application/json").otherwise("text/html")
    return df.select(F.col(url).alias("url"), (F.lit(200) if status is None else status).cast("int").alias("status"), kind.alias("content_type"), F.col(body).alias("body"))


def safe_input(path: str, root: str, folders: tuple[str, ...] = ("uploads", "samples")) -> str:
    """path under root, in an allowed folder or a .json file at its top; else ValueError."""
    if "\x00" in path or ".." in Path(path).parts:
        raise ValueError("path leaves the allowed folders")
    base, full = Path(root).resolve(), (Path(root) / path).resolve()
    parts = full.relative_to(base).parts if full.is_relative_to(base) else ()
    if not parts or not (parts[0] in folders or len(parts) == 1 and full.suffix == ".json"):
        raise ValueError("path is outside the allowed folders")
    return str(full)


def safe_output(name: str) -> str:
    """First part of an output folder's name: begins with `output`, at most 80 characters."""
    first = Path(name).parts[0] if Path(name).parts else ""
    if "\x00" in name or ".." in Path(name).parts or not re.fullmatch(r"output[\w.-]*", first) or len(first) > 80:
        raise ValueError("an output folder's name begins with `output`")
    return first


def safe_file_name(name: str) -> str:
    return re.sub(r"[^a-zA-Z0-9._-]", "_", name)[:128]
