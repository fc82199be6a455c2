"""The flagship run: a catalog in, cleaned records, groups, reports and checks out."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlode.functions import vocab
from siftlode.functions.plan import barrier, release
from siftlode.operators import audit, dedupe, judge, names, probes, urls
from siftlode.rules import chain
from siftlode.sources import sinks


@dataclass(frozen=True)
class Options:
    """Switches of a run, with the defaults of the command line they replace."""

    as_of: int
    dedupe_level: str = "conservative"
    group_mode: str = "category-first"
    name_mode: str = "loose"
    keep_latin: bool = False
    keep_disabled: bool = False
    only_enabled: bool = False
    include_non_http: bool = True
    allow_risky: bool = False
    include_unavailable: bool = False
    include_unknown: bool = False
    include_complex: bool = False
    write_meta: bool = False
    write_normalized_url: bool = False
    respect_prefilters: bool = True
    validate_mode: str | None = None
    strict: bool = False


@dataclass
class Report:
    """Lazy tables of a run; checks(), write() and verify() act.

    scored: every record before duplicates were looked for; reviewed: every record with its outcome.
    Both are persisted, as summary, checks, groups and a dozen files read them; release() lets them go."""

    options: Options
    scored: DataFrame
    reviewed: DataFrame
    marked: DataFrame | None
    batch: DataFrame | None = None

    def release(self) -> None:
        if "groups" in self.__dict__:
            release(self.groups)
        self.reviewed.unpersist()
        self.scored.unpersist()

    @cached_property
    def groups(self) -> DataFrame:
        if self.marked is None:
            return self.reviewed.sparkSession.createDataFrame([], "dedupe_key string, group_key string, kept_idx long, kept_name string, size long, dup_risk boolean, reason string, group_id long")
        return dedupe.groups(self.marked, self.options.dedupe_level)

    def listed_groups(self) -> DataFrame:
        """groups with the removed members of each, in order."""
        if self.marked is None:
            return self.groups.select("group_id", F.lit(0).alias("part"), "group_key", "kept_idx", F.array().cast("array<bigint>").alias("removed_indices"), "reason")
        return dedupe.listed(self.marked, self.groups)

    @property
    def kept(self) -> DataFrame:
        return self.reviewed.where("kept")

    def output(self) -> DataFrame:
        """Kept rows as they are written: idx, name, url, grp, type, category, availability, file_key."""
        url = F.when((F.col("norm.url_status") == "VALID_HTTP"), F.col("norm.url")).otherwise(F.col("url")) if self.options.write_normalized_url else F.col("url")
        return self.kept.select("idx", F.coalesce(F.nullif("cleaned_name", F.lit("")), "name").alias("name"), url.alias("url"), F.col("final_group").alias("grp"), "type", "category", "availability", judge.file_key(F.col("category")).alias("file_key"))

    def zone_stats(self) -> DataFrame:
        return audit.zone_stats(self.reviewed)

    def summary(self) -> DataFrame:
        """One row of counters."""
        c = F.count_if
        st, av, gone = F.col("structure.status"), F.col("availability"), F.col("removed_reason")
        counts = [c(av == a).alias(a) for a in vocab.AVAILABILITY_RANK]
        kinds = [c(F.col("kept") & (F.col("category") == x)).alias(f"kept_{k}") for x, k in vocab.FILE_KEYS.items()]
        return self.reviewed.agg(
            F.count("*").alias("input_total"), c(F.col("kept")).alias("output_total"), c(~F.col("after_dedupe")).alias("duplicate_count"), c(gone.startswith("Duplicate of")).alias("exact_duplicate_count"),
            c(gone.startswith("Excluded:")).alias("unavailable_count"), c(gone.startswith("Filtered:")).alias("filtered_count"), c(st == "STRUCTURE_OK").alias("ok_count"), c(st == "STRUCTURE_WARN").alias("warn_count"), c(st == "STRUCTURE_INVALID").alias("invalid_count"),
            *counts, *kinds, F.round(F.avg(F.when(F.col("respond_time") >= 0, F.col("respond_time")))).cast("long").alias("average_respond_time"))

    def top_reasons(self, k: int = 10) -> DataFrame:
        """(reason, n): the failure reasons of the batch, most frequent first."""
        if self.batch is None:
            return self.reviewed.sparkSession.createDataFrame([], "reason string, n long")
        return probes.top_reasons(self.batch, k)

    def duplicate_risk(self) -> DataFrame:
        """dedupe.pairs() of the run, with each group's note and reason."""
        if self.marked is None:
            return self.groups.select("group_key", "kept_idx").where(F.lit(False))
        note = self.groups.select(F.col("dedupe_key").alias("__key"), "group_key", "reason")
        return dedupe.pairs(self.marked).join(note, F.col("dedupe_key") == F.col("__key")).drop("__key", "dedupe_key")

    def checks(self, cleaned: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
        """The checks of what was written (see written()); without that, of the rows that would be."""
        s = self.summary().first()
        out = self.output()
        found = audit.checks(self.reviewed, cleaned or out, groups or out, s.input_total, s.output_total)
        if self.options.strict and not found.where("not pass").isEmpty():
            raise RuntimeError("the output failed its checks: " + ", ".join(r.id for r in found.where("not pass").collect()))
        return found

    def written(self, out_dir: str) -> tuple[DataFrame, DataFrame]:
        """(cleaned, groups) as they stand under out_dir: what each file says of name, url, group and
        category, by the record's index where it was written, else by that of the record of its url and name."""
        spark = self.reviewed.sparkSession
        lines = spark.read.schema("json string").text(f"{out_dir}/cleaned-sources")
        parts = spark.read.schema("json string, file_key string").text(f"{out_dir}/groups")
        fields = "originalIndex long, bookSourceName string, bookSourceUrl string, bookSourceGroup string, bookSourceType int, finalCategory string"
        own = self.output().select(F.col("idx").alias("oi"), F.col("name").alias("oname"), F.col("url").alias("ourl"), F.col("category").alias("ocat"), F.col("availability").alias("oav"))

        def read(df: DataFrame, *more: str) -> DataFrame:
            row = df.select(F.from_json("json", fields).alias("r"), *more).where("r.bookSourceName is not null")
            row = row.select(F.col("r.originalIndex").alias("idx"), F.col("r.bookSourceName").alias("name"), F.col("r.bookSourceUrl").alias("url"), F.col("r.bookSourceGroup").alias("grp"), F.col("r.bookSourceType").alias("type"), F.col("r.finalCategory").alias("fcat"), *more)
            if self.options.write_meta:
                known = row.join(own, F.col("idx") == F.col("oi"), "left")
            else:
                one = own.groupBy("oname", "ourl").agg(*(F.min_by(x, "oi").alias(x) for x in ("ocat", "oav")), F.min("oi").alias("oi"))
                known = row.join(one, F.col("name").eqNullSafe(F.col("oname")) & F.col("url").eqNullSafe(F.col("ourl")), "left").withColumn("idx", F.col("oi"))
            return known.select("idx", "name", "url", "grp", "type", F.coalesce("fcat", "ocat").alias("category"), F.col("oav").alias("availability"), *more)

        cleaned = read(lines)
        return cleaned.withColumn("file_key", judge.file_key(F.col("category"))), read(parts, "file_key")

    def verify(self, out_dir: str) -> DataFrame:
        """checks() over what write() has written under out_dir."""
        return self.checks(*self.written(out_dir))

    def write(self, out_dir: str, pretty: bool = True) -> None:
        """Folders of JSON and CSV under out_dir; groups are partitioned by file key.  The audits are made
        of what was written, read again."""
        o, rows = self.options, self.reviewed
        kept = self.kept.withColumn("file_key", judge.file_key(F.col("category")))
        if "raw" in rows.columns:
            body = sinks.rebuilt(kept, o.write_meta, o.write_normalized_url, keep=("file_key",))
        else:
            out = self.output()
            named = F.struct(F.col("idx").alias("originalIndex"), F.col("name").alias("bookSourceName"), F.col("url").alias("bookSourceUrl"), F.col("grp").alias("bookSourceGroup"), F.col("type").alias("bookSourceType"), F.col("category").alias("finalCategory"))
            body = out.select("idx", F.to_json(named).alias("json"), "file_key")
        body.select("json").write.mode("overwrite").text(f"{out_dir}/cleaned-sources")
        body.select("file_key", "json").write.mode("overwrite").partitionBy("file_key").text(f"{out_dir}/groups")
        sinks.write_array(body.select("idx", "json"), f"{out_dir}/cleaned-sources.json")
        flat = rows.drop("raw")
        for name, cond in (("all-sources-reviewed", None), ("reports/sources", None), ("reports/structural-invalid", "structure.status = 'STRUCTURE_INVALID'"), ("reports/unavailable", "availability in ('dead', 'timeout', 'forbidden')"), ("reports/risky", "availability in ('unknown', 'complex_unverified') or confidence in ('low', 'conflict') or size(risks) > 0")):
            one = flat if cond is None else flat.where(cond)
            if name == "reports/sources":
                one = one.select("idx", "name", "cleaned_name", "url", "grp", "category", "confidence", "type", F.col("norm.normalized_host").alias("host"), F.col("structure.status").alias("structure"), "availability", "score", "final_group", "kept", "removed_reason")
            one.write.mode("overwrite").json(f"{out_dir}/{name}")
        listed = self.listed_groups().persist(StorageLevel.MEMORY_AND_DISK)
        listed.write.mode("overwrite").json(f"{out_dir}/reports/duplicates")
        batch = None if self.batch is None else self.batch.persist(StorageLevel.MEMORY_AND_DISK)
        wide = sinks.with_batch(rows, batch)
        sinks.write_csv(wide, sinks.sources_csv(wide), f"{out_dir}/reports/sources.csv")
        sinks.write_csv(listed, sinks.duplicates_csv(), f"{out_dir}/reports/duplicates.csv")
        cleaned, groups = self.written(out_dir)
        reasons = F.array_join("structure.reasons", "; ")
        audits = {
            "dirty-names": (audit.dirty_names(groups), None),
            "group-mismatches": (audit.group_mismatches(groups), None),
            "cleaned-vs-groups-diff": (audit.group_diffs(cleaned, groups), None),
            "duplicate-risk": (self.duplicate_risk(), None),
            "structural-invalid": (rows.where("structure.status = 'STRUCTURE_INVALID'"), {"originalIndex": F.col("idx"), "name": F.col("name"), "url": F.col("url"), "validationStatus": F.col("structure.status"), "missingFields": reasons}),
            "unavailable": (rows.where("availability in ('dead', 'timeout', 'forbidden')"), {"originalIndex": F.col("idx"), "name": F.col("name"), "url": F.col("url"), "availability": F.col("availability"), "reason": F.col("removed_reason"), "statusCode": F.col("connectivity")}),
        }
        for name, (found, columns) in audits.items():
            sinks.write_csv(found, columns or {c: F.col(c) for c in found.columns}, f"{out_dir}/reports/{name}.csv", audit=True)
            if name in ("dirty-names", "group-mismatches", "cleaned-vs-groups-diff"):
                found.write.mode("overwrite").json(f"{out_dir}/reports/{name}")
        self.checks(cleaned, groups).write.mode("overwrite").json(f"{out_dir}/reports/output-consistency")
        if batch is not None:
            probes.batch_summary(batch).write.mode("overwrite").json(f"{out_dir}/reports/batch-summary")
        totals = self.summary().first().asDict()
        sinks.write_text(rows.sparkSession, f"{out_dir}/reports/summary.json", json.dumps(totals, indent=2 if pretty else None, ensure_ascii=False))
        shown = rows.select("idx", "name", "cleaned_name", "category", "availability", "score", "kept", "removed_reason").orderBy("idx")
        tables = {"categories": rows.where("kept").groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category"), "failure reasons": self.top_reasons()}
        tables |= {"kept": shown.where("kept"), "removed": shown.where("not kept"), "duplicates": self.groups.select("group_id", "group_key", "kept_name", "size", "reason").orderBy("group_id")}
        sinks.write_text(rows.sparkSession, f"{out_dir}/reports/report.html", sinks.html_report(totals, tables))
        listed.unpersist()
        if batch is not None:
            batch.unpersist()


def only_enabled(enabled: Column) -> Column:
    """Records that say they are enabled; one that says nothing is not."""
    return F.coalesce(enabled, F.lit(False))


def not_disabled(enabled: Column) -> Column:
    """Records that do not say they are disabled."""
    return F.coalesce(enabled, F.lit(True))


def prefilter(o: Options) -> Column:
    """Reason for which the input switches drop a record, or null."""
    why = F.lit(None).cast("string")
    if o.only_enabled:
        why = F.when(~only_enabled(F.col("enabled")), "Filtered: --only-enabled (source not enabled)").otherwise(why)
    if not o.keep_disabled:
        why = F.when(~not_disabled(F.col("enabled")), "Filtered: disabled source excluded").otherwise(why)
    return why


def process(catalog: DataFrame, options: Options, pages: DataFrame | None = None, connectivity: DataFrame | None = None) -> Report:
    """catalog: flat columns of siftlode.sources.catalog.  connectivity (idx, connectivity, search_status,
    measured_respond_time): what an online run found; without it nothing is NOT checked offline.
    pages: the page store that validate_mode `standard` or `deep` follows the rules through."""
    o = options
    mode = probes.validate_mode(o.validate_mode)
    if o.validate_mode and mode is None:
        raise ValueError(f"validate_mode is one of {', '.join(vocab.VALIDATE_MODES)}, not {o.validate_mode!r}")
    if mode in ("standard", "deep") and pages is None:
        raise ValueError(f"validate_mode {mode} follows the rules through pages, and none were given")
    df = catalog.withColumn("filtered", prefilter(o))
    df = names.clean_names(df, mode=o.name_mode, keep_latin=o.keep_latin, url=F.col("url"), index=F.col("idx"))
    df = urls.with_url(df.withColumn("cleaned_name", F.col("clean.cleaned")))
    if not o.include_non_http:
        df = df.withColumn("filtered", F.when(F.col("norm.url_status") != "VALID_HTTP", "Filtered: non-HTTP source excluded").otherwise(F.col("filtered")))
    df = judge.classify(df)
    df = df.withColumns({"category": F.col("cls.category"), "confidence": F.col("cls.confidence")})
    df = df.withColumns({"structure": judge.structure(F.col("category")), "login": judge.login_status()})
    found = ("connectivity", "search_status", "measured_respond_time")
    if connectivity is not None:
        df = df.join(connectivity.select(F.col("idx").alias("__i"), *found), df.idx == F.col("__i"), "left").drop("__i")
    df = df.withColumns({"connectivity": F.coalesce(F.col("connectivity") if connectivity is not None else F.lit(None).cast("string"), F.lit("NOT_CHECKED")), "search_status": F.coalesce(F.col("search_status") if connectivity is not None else F.lit(None).cast("string"), F.lit("NOT_CHECKED")),
                         "measured_respond_time": (F.col("measured_respond_time") if connectivity is not None else F.lit(None)).cast("double")})
    df = df.withColumn("availability", judge.availability(F.col("structure.status"), F.col("login"), F.col("connectivity"), F.col("search_status"), F.col("search_url")))
    scored = judge.score(barrier(df), o.as_of).persist(StorageLevel.MEMORY_AND_DISK)
    gone = lambda d: d.withColumns({"after_dedupe": F.col("filtered").isNull(), "duplicate_reason": F.lit(None).cast("string"), "duplicate_group": F.lit(None).cast("string")})
    marked = None
    if o.dedupe_level == "none":
        df = gone(scored)
    else:
        # a filtered record takes no part in its key's group, unless literal behaviour is asked for
        marked = dedupe.dedupe(scored.where("filtered is null") if o.respect_prefilters else scored, o.dedupe_level, o.allow_risky)
        df = marked.withColumns({"after_dedupe": F.col("dup_kept"), "duplicate_reason": dedupe.removed_reason(), "duplicate_group": F.when(F.col("dup_size") > 1, F.col("dedupe_key"))}).select(*scored.columns, "after_dedupe", "duplicate_reason", "duplicate_group")
        if o.respect_prefilters:
            df = df.unionByName(gone(scored.where("filtered is not null")))
    g = judge.final_group(o.group_mode, F.col("category"), F.col("grp"))
    df = df.withColumns({"final_group": g["final_group"], "group_change_reason": g["reason"]})
    out = judge.excluded(F.col("availability"), o.include_unavailable, o.include_unknown, o.include_complex)
    reason = F.coalesce(F.col("duplicate_reason"), F.when(~F.col("after_dedupe"), F.col("filtered")), F.when(out, F.concat(F.lit("Excluded: availability="), F.col("availability"))))
    reviewed = barrier(df.withColumns({"kept": F.col("after_dedupe") & ~out, "removed_reason": reason})).persist(StorageLevel.MEMORY_AND_DISK)
    batch = None
    if mode:
        target = reviewed.where("kept and norm.url_status = 'VALID_HTTP' and structure.status <> 'STRUCTURE_INVALID'")
        deep = None if mode == "fast" else chain.verify_chain(target, pages, "content" if mode == "deep" else "toc")
        batch = chain.batch_results(target, deep, mode)
    return Report(o, scored, reviewed, marked, batch)


def inspect(catalog: DataFrame, k: int = 10) -> dict[str, DataFrame]:
    """Tables that describe a catalog as it comes in: flags, types, the k most frequent groups, duplicate hosts."""
    hosts = urls.with_url(catalog.select("idx", "url")).groupBy(F.col("norm.normalized_host").alias("host")).agg(F.count("*").alias("n")).where("host is not null and n > 1")
    return {"flags": audit.inspect_flags(catalog), "types": audit.count_by(catalog, "type", "undefined"), "groups": audit.top_groups(catalog, k), "duplicate_hosts": hosts}


def validate(catalog: DataFrame, options: Options, pages: DataFrame, mode: str = "deep") -> DataFrame:
    """Batch results of a catalog's records that are fit for it, duplicates included."""
    return process(catalog, replace(options, dedupe_level="none", validate_mode=mode), pages).batch


def split(catalog: DataFrame, options: Options, out_dir: str) -> None:
    """The catalog as it is, one folder for each category under out_dir/groups."""
    df = names.clean_names(catalog, mode=options.name_mode, keep_latin=options.keep_latin, url=F.col("url"), index=F.col("idx")).withColumn("cleaned_name", F.col("clean.cleaned"))
    rows = judge.classify(df).select(judge.file_key(F.col("cls.category")).alias("file_key"), F.to_json("raw").alias("json"))
    rows.write.mode("overwrite").partitionBy("file_key").text(f"{out_dir}/groups")


def debug(catalog: DataFrame, pages: DataFrame, idx: int, keyword: str | None = None) -> DataFrame:
    """What every stage of one record found, stage by stage."""
    df = names.clean_names(catalog.where(F.col("idx") == idx), url=F.col("url"), index=F.col("idx")).withColumn("cleaned_name", F.col("clean.cleaned"))
    df = judge.classify(df).withColumn("category", F.col("cls.category"))
    return chain.verify_chain(df, pages, keyword=None if keyword is None else F.lit(keyword))
