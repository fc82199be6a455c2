"""Timestamps (epoch milliseconds) shown to people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts for a missing time, one just passed, and whole units: (milliseconds, least count, text).
MISSING, UNKNOWN, NOW = "N/A", "未知", "刚刚"
DAY = 86_400_000
UNITS = ((365 * DAY, 366 * DAY, "年前"), (30 * DAY, 31 * DAY, "个月前"), (DAY, DAY, "天前"), (3_600_000, 3_600_000, "小时前"), (60_000, 60_000, "分钟前"))


#: Milliseconds, either way, that a timestamp reaches to.
LATEST = 9_223_372_036_854_775


def shown(ms: Column) -> Column:
    """`yyyy-MM-dd HH:mm:ss` in UTC whatever the session's zone.

    Years before 0 and after 9999 are plain numbers; a time that no timestamp holds is shown as it came."""
    held = F.when(ms.between(-LATEST, LATEST), ms)
    rest = F.pmod(held, F.lit(DAY))
    # from the day itself: a zone has hours that it skips
    day, second = F.date_from_unix_date(((held - rest) / DAY).cast("int")), F.floor(rest / 1000)
    date = F.when(F.year(day).between(0, 9999), day.cast("string")).otherwise(F.concat(F.year(day).cast("string"), F.right(day.cast("string"), F.lit(6))))
    clock = F.format_string("%02d:%02d:%02d", F.floor(second / 3600), F.floor(second / 60) % 60, second % 60)
    return F.coalesce(F.concat(date, F.lit(" "), clock), ms.cast("string"), F.lit(MISSING))


def ago(ms: Column, as_of: int) -> Column:
    """Age in the largest whole unit; years only beyond 365 days, months only beyond 30."""
    passed = F.lit(as_of) - ms
    out = F.lit(NOW)
    for size, least, text in reversed(UNITS):
        out = F.when(passed >= least, F.concat(F.floor(passed / size).cast("string"), F.lit(text))).otherwise(out)
    return F.when(F.coalesce(ms <= 0, F.lit(True)), UNKNOWN).otherwise(out)
