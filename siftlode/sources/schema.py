"""What types the fields of open records have, at every depth, and where they differ from those declared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The declared fields by kind; `?` admits null.
_STRINGS = (
    "bookSourceName bookSourceUrl bookSourceGroup bookSourceComment variableComment bookUrlPattern searchUrl exploreUrl header concurrentRate loginUrl loginUi loginCheckJs jsLib "
    "ruleSearch.bookList ruleSearch.name ruleSearch.author ruleSearch.kind ruleSearch.wordCount ruleSearch.lastChapter ruleSearch.intro ruleSearch.coverUrl ruleSearch.bookUrl ruleSearch.checkKeyWord "
    "ruleBookInfo.name ruleBookInfo.author ruleBookInfo.kind ruleBookInfo.wordCount ruleBookInfo.lastChapter ruleBookInfo.intro ruleBookInfo.coverUrl ruleBookInfo.tocUrl "
    "ruleToc.chapterList ruleToc.chapterName ruleToc.chapterUrl ruleToc.isVolume ruleToc.updateTime "
    "ruleContent.content ruleContent.nextContentUrl ruleContent.webJs ruleContent.sourceRegex ruleContent.imageStyle"
)
DECLARED = (
    {"$": "object"}
    | {f"$.{p}": "string" for p in _STRINGS.split()}
    | {"$.bookSourceType": "integer?", "$.respondTime": "number?", "$.lastUpdateTime": "number?", "$.weight": "number?"}
    | {f"$.{p}": "boolean?" for p in ("enabled", "enabledExplore", "enabledCookieJar")}
    | {f"$.{p}": "object?" for p in ("ruleSearch", "ruleBookInfo", "ruleToc", "ruleContent")}
)


def kind(v: Column) -> Column:
    """object, array, string, boolean, integer, number or null; a number without a fraction is an integer."""
    name = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    plain = F.when(name == "VOID", "null").when(name.isin("OBJECT", "ARRAY", "STRING", "BOOLEAN"), F.lower(name))
    return plain.otherwise(F.when(F.try_variant_get(v, "$", "double") % 1 == 0, "integer").otherwise("number"))


def paths(records: DataFrame, idx: str = "idx", record: str = "record", depth: int = 6) -> DataFrame:
    """(idx, record variant) -> idx, path, kind: one row for each value of a record down to `depth` levels, the record itself among them.

    Items of an array share the path `[*]`.  What lies deeper is not looked at: its parent is told as object or
    array.  One pass over the records: each level turns a row into itself and its children.  A null record gives
    no rows; other columns are ignored."""
    node = lambda path, v: F.struct(path.alias("path"), kind(v).alias("kind"), v.alias("v"))
    rows = records.where(F.col(record).isNotNull()).select(F.col(idx).alias("idx"), F.inline(F.array(node(F.lit("$"), F.col(record)))))
    for _ in range(depth):
        path, v = F.col("path"), F.col("v")
        done = F.array(F.struct("path", "kind", F.lit(None).cast("variant").alias("v")))
        fields = F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: node(F.concat(path, F.lit("."), e["key"]), e["value"]))
        items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda e: node(F.concat(path, F.lit("[*]")), e))
        below = F.when(F.col("kind") == "object", fields).when(F.col("kind") == "array", items)
        rows = rows.select("idx", F.inline(F.when(v.isNotNull() & below.isNotNull(), F.concat(done, below)).otherwise(done)))
    return rows.select("idx", "path", "kind")


def issues(records: DataFrame, idx: str = "idx", record: str = "record", declared: dict[str, str] = DECLARED) -> DataFrame:
    """idx, path, expected, found: each declared field of another type.  Fields that are absent or not declared are none.

    Null is an issue where the declared kind does not end in `?`; an integer is a number."""
    depth = max((p.count(".") + p.count("[*]") for p in declared), default=0)
    want = F.create_map(*[F.lit(x) for pair in declared.items() for x in pair])
    found = paths(records, idx, record, depth).withColumn("want", F.try_element_at(want, F.col("path"))).where("want is not null")
    expected, null = F.rtrim(F.col("want"), F.lit("?")), F.col("kind") == "null"
    fits = (F.col("kind") == expected) | ((expected == "number") & (F.col("kind") == "integer")) | (null & F.endswith("want", F.lit("?")))
    return found.where(~fits).select("idx", "path", expected.alias("expected"), F.col("kind").alias("found"))


def drift(records: DataFrame, idx: str = "idx", record: str = "record", depth: int = 6) -> DataFrame:
    """path, kind, n, first_idx: what a catalog is made of; sums, combined before the shuffle."""
    return paths(records, idx, record, depth).groupBy("path", "kind").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"))
