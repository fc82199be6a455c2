"""Display-name cleaning: a chain of expressions whose every change is recorded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlode.functions import vocab
from siftlode.functions.plan import barrier
from siftlode.functions.text import CJK, EMOJI, NOT_S, WS, S, squeeze, sub, trim

RESULT = "struct<cleaned:string,warnings:array<string>,steps:array<struct<reason:string,from:string,to:string>>>"


def strip_emoji(c: Column) -> Column:
    return sub(c, EMOJI)


def strip_quality_brackets(c: Column) -> Column:
    q = vocab.QUALITY_WORDS
    for opening, closing in (("[（(]", "[）)]"), ("【", "】"), (r"\[", r"\]")):
        c = sub(c, f"(?i){opening}{S}*{q}{S}*{closing}", " ")
    return c


def strip_maintainer(c: Column) -> Column:
    for pattern in (f"@{NOT_S}+", f"{S}+[Bb][Yy]{S}+{NOT_S}+", f"{S}*[┃|｜]{S}*{NOT_S}+"):
        c = sub(c, pattern, " ")
    return c


def strip_quality_labels(c: Column) -> Column:
    for word in vocab.QUALITY_LABELS:
        c = sub(c, f"{S}*{word}{S}*", " ")
    return c


STEPS = (
    ("removedEmoji", strip_emoji),
    ("removedQualityBrackets", strip_quality_brackets),
    ("removedMaintainerSuffix", strip_maintainer),
    ("removedHashComment", lambda c: trim(sub(c, f"#[^0-9{WS}]{NOT_S}*{S}*\\z", " "))),
    ("removedVersionMarker", lambda c: trim(sub(c, f"#[0-9]+{S}*\\z", " "))),
    ("removedAnnotationBrackets", lambda c: sub(c, f"(?i){S}*[（(]{vocab.ANNOTATIONS}[）)]{S}*", " ")),
    ("removedQualityLabels", strip_quality_labels),
    ("removedFancySymbols", lambda c: F.translate(c, vocab.FANCY_SYMBOLS, " " * len(vocab.FANCY_SYMBOLS))),
)


def only_chinese(c: Column, keep_latin: bool = False) -> Column:
    latin = "A-Za-z" if keep_latin else ""
    return sub(c, f"[^{CJK}\\x{{3400}}-\\x{{4dbf}}\\x{{f900}}-\\x{{faff}}0-9\\-—·• \\x{{3000}}{latin}]")


def clean_names(df: DataFrame, name: str = "name", mode: str = "loose", keep_latin: bool = False, host: Column | None = None, url: Column | None = None, index: Column | None = None, into: str = "clean") -> DataFrame:
    """df + a struct column `into` (cleaned, warnings, steps).

    Every step is a column of its own, so each regular expression runs once a row; the log keeps the
    steps that changed something.  An empty result falls back to the bare name, host, url, index.
    """
    prefix = f"__{into}_"
    df = df.withColumn(f"{prefix}0", trim(F.coalesce(F.col(name), F.lit(""))))
    for i, (_, step) in enumerate(STEPS, 1):
        df = df.withColumn(f"{prefix}{i}", step(F.col(f"{prefix}{i - 1}")))
    last = squeeze(F.col(f"{prefix}{len(STEPS)}"))
    if mode == "zh-only":
        last = squeeze(only_chinese(last, keep_latin))
    df = df.withColumn(f"{prefix}last", last)
    bare = trim(sub(sub(F.coalesce(F.col(name), F.lit("")), f"[{vocab.LEGACY_EMOJI}]"), f"[^A-Za-z0-9_{CJK}{WS}\\-]"))
    names = [(F.col(f"{prefix}last"), None), (bare, "CLEAN_NAME_EMPTY_FALLBACK")]
    names += [(host, "CLEAN_NAME_EMPTY_FALLBACK_HOST")] if host is not None else []
    names += [(url, "CLEAN_NAME_EMPTY_FALLBACK_URL")] if url is not None else []
    names += [(F.concat(F.lit("未命名源-"), index.cast("string")), "CLEAN_NAME_EMPTY_FALLBACK_INDEX")] if index is not None else []
    picks = [F.when(c != "", F.struct(c.alias("cleaned"), F.lit(w).cast("string").alias("warning"))) for c, w in names]
    pick = F.coalesce(*picks, F.struct(F.lit("").alias("cleaned"), F.lit("CLEAN_NAME_EMPTY_FALLBACK").alias("warning")))
    df = df.withColumn(f"{prefix}pick", pick)
    log = F.filter(F.array(*[F.struct(F.lit(r).alias("reason"), F.col(f"{prefix}{i - 1}").alias("from"), F.col(f"{prefix}{i}").alias("to")) for i, (r, _) in enumerate(STEPS, 1)]), lambda s: s["from"] != s["to"])
    empty = F.col(f"{prefix}0") == ""
    out = F.when(empty, F.struct(F.lit("").alias("cleaned"), F.array(F.lit("EMPTY_NAME")).alias("warnings"), F.array().cast("array<struct<reason:string,from:string,to:string>>").alias("steps"))).otherwise(
        F.struct(F.col(f"{prefix}pick.cleaned").alias("cleaned"), F.array_compact(F.array(F.col(f"{prefix}pick.warning"))).alias("warnings"), log.alias("steps")))
    return barrier(df.withColumn(into, out)).drop(*[c for c in (f"{prefix}{x}" for x in [*range(len(STEPS) + 1), "last", "pick"])])


# What marks a name as not clean: (issue, pattern).
DIRTY = (
    ("emoji", f"[{vocab.PICTOGRAPHIC}]"),
    ("var-selector", r"[\x{FE00}-\x{FE0F}]"),
    ("zwj", r"[\x{200D}\x{200B}\x{200C}]"),
    ("quality-brackets-cn", f"[（(]{S}*{vocab.DIRTY_QUALITY}{S}*[）)]"),
    ("quality-fullwidth", f"【{S}*{vocab.DIRTY_QUALITY.replace('|已校验', '')}{S}*】"),
    ("maintainer-at", f"@[^{WS},，]+"),
    ("hash-suffix-cjk", f"#[{CJK}]{NOT_S}*{S}*\\z"),
    ("quality-label-trailing", r"(?:优\+{2,3}|优质|已校验|暂不可用|维护中|校验超时)" + f"{S}*\\z"),
)


def dirty_issues(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    return F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(n)) for n, p in DIRTY]))
