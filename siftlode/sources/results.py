"""What a run has written, read again: reports, lookups, issues."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables under reports/ that a run writes as JSON folders.
REPORTS = ("sources", "structural-invalid", "unavailable", "risky", "duplicates", "output-consistency", "dirty-names", "group-mismatches", "cleaned-vs-groups-diff", "batch-summary")


def summary(spark: SparkSession, out_dir: str) -> dict | None:
    """The counters of a run; None if there is none under out_dir."""
    try:
        return json.loads(spark.read.text(f"{out_dir}/reports/summary.json", wholetext=True).first().value)
    except AnalysisException:
        return None


def report(spark: SparkSession, out_dir: str, name: str) -> DataFrame | None:
    """A table of REPORTS; None where the run wrote none, or one without rows."""
    if name not in REPORTS:
        raise ValueError(f"no report is named {name!r}")
    try:
        found = spark.read.json(f"{out_dir}/reports/{name}")
    except AnalysisException:
        return None
    return found if found.columns else None


def source(spark: SparkSession, out_dir: str, idx: int) -> dict | None:
    """What a run says of one record."""
    rows = report(spark, out_dir, "sources")
    found = rows.where(F.col("idx") == idx).first() if rows is not None else None
    return found.asDict(recursive=True) if found else None


def issues(spark: SparkSession, out_dir: str) -> dict[str, DataFrame | None]:
    """All tables that tell of something to look at; duplicate_risks: the groups kept for their conflicts."""
    found = {n: report(spark, out_dir, n) for n in REPORTS if n not in ("sources", "batch-summary")}
    groups = found["duplicates"]
    return found | {"duplicate_risks": groups.where("dup_risk") if groups is not None and "dup_risk" in groups.columns else None}
