"""What a network run says about a record: pure decision tables, and fetchers that are given to them."""

from __future__ import annotations

import ipaddress
import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager, nullcontext
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlode.functions import vocab
from siftlode.functions.text import ascii_bounded, blank, filled, matches
from siftlode.operators import hosts, judge, urls

STAGES = ("search", "bookInfo", "toc", "content")


def connectivity_status(status: Column, error: Column) -> Column:
    """Status of a fetched site: its HTTP status, or what the error says."""
    return (
        F.when(matches(error, "(?i)abort|timeout"), "CONNECT_TIMEOUT").when(error.isNotNull() | status.isNull(), "CONNECT_ERROR")
        .when(status.isin(401, 403), "CONNECT_FORBIDDEN").when(status.isin(404, 410), "CONNECT_DEAD")
        .when((status == 429) | (status >= 500), "CONNECT_ERROR").otherwise("CONNECT_OK")
    )


def error_page(body: Column) -> Column:
    b = F.lower(F.coalesce(body, F.lit("")))
    return matches(b, "cloudflare|captcha|403 forbidden|access denied|请登录|verification|blocked") | (F.contains(b, F.lit("登录")) & F.contains(b, F.lit("密码")))


def blocked_page(body: Column) -> Column:
    return matches(F.lower(body), "cloudflare|captcha|verification|blocked|access denied")


def error_body(body: Column) -> Column:
    """The chain's test: short bodies count as errors too."""
    b = F.lower(F.coalesce(body, F.lit("")))
    return matches(b, "cloudflare|captcha|403 forbidden|access denied|verification|blocked") | (F.contains(b, F.lit("请登录")) & F.contains(b, F.lit("密码"))) | (F.length(b) < 50)


def complex_js(c: Column) -> Column:
    return matches(c, "(?i)" + "|".join(ascii_bounded(p) for p in vocab.COMPLEX_JS))


def search_precheck(base: Column) -> Column:
    """Search status that needs no request; null where the request decides.  Over search_url and others."""
    fields = F.concat_ws("\n", "search_url", "explore_url", "login_url", "login_check_js", "js_lib")
    hard = matches(fields, "(?i)" + ascii_bounded(r"\beval\b") + r"|java\.ajax")
    target = urls.search_request(F.col("search_url"), F.coalesce(base, F.lit("")), F.lit("x"), F.lit(1))["url"]
    return (
        F.when(blank(F.col("search_url")), "SEARCH_UNVERIFIED").when(complex_js(F.col("search_url")), "SEARCH_COMPLEX_JS_SKIPPED").when(hard, "SEARCH_SKIPPED_JS")
        .when(urls.has_template_js(F.regexp_extract("search_url", r"^(.*?)(?:,\{|\z)", 1)), "SEARCH_TEMPLATE_COMPLEX")
        .when(~matches(target, urls.HTTP), F.when(filled(base) & ~matches(base, "(?i)^https?://"), "SEARCH_SKIPPED_NON_HTTP").otherwise("SEARCH_UNVERIFIED"))
    )


def search_status(status: Column, body: Column, error: Column, list_rule: Column) -> Column:
    """Search status of a response."""
    ok = status.between(200, 299) & (F.length(body) > 50)
    likely = filled(list_rule) & (F.length(body) > 200)
    json = F.try_parse_json(body).isNotNull()
    return F.when(error.isNotNull(), "SEARCH_FAILED").when(~F.coalesce(ok, F.lit(False)), "SEARCH_UNVERIFIED").when(error_page(body), "SEARCH_FAILED").when(likely, "SEARCH_RULE_LIKELY_OK").when(json, "SEARCH_PARSE_OK").otherwise("SEARCH_HTTP_OK")


def fetch_failure(status: Column, body: Column, error: Column) -> Column:
    """Why a fetched stage cannot go on; null where it can."""
    good = F.coalesce(status.between(200, 299), F.lit(False)) & ~error_body(body)
    return (
        F.when(good, F.lit(None).cast("string")).when(status == 403, "http_403").when(blocked_page(body), "cloudflare_detected").when(error == "ssrf_blocked", "ssrf_blocked")
        .when(error == "timeout", "http_timeout").when(error.isin("dns_failed", "connection_error", "network_error"), "network_error").otherwise("empty_response")
    )


def batch_status(structure: Column, search_url: Column, url: Column, reasons: Column, login: Column, availability: Column, stages: Column, risks: Column) -> Column:
    """Outcome of deep validation; stages: array of struct(stage, status), empty where none was run."""
    said = lambda *names: F.arrays_overlap(reasons, F.array(*map(F.lit, names)))
    passed = F.exists(stages, lambda s: s["status"] == "PASS")
    clean = F.forall(stages, lambda s: s["status"].isin("PASS", "SKIPPED"))
    found = F.exists(stages, lambda s: (s["stage"] == "search") & (s["status"] == "PASS"))
    failed = F.exists(stages, lambda s: s["status"] == "FAIL")
    fast = F.when(availability == "usable", "PASS").when(availability == "probably_usable", "PARTIAL_PASS").when(availability == "forbidden", "BLOCKED").when(availability.isin("dead", "timeout"), "FAIL").when(availability == "needs_login", "NEEDS_LOGIN").when(availability == "complex_unverified", "RISKY").otherwise("UNKNOWN")
    first = (
        F.when(structure == "STRUCTURE_INVALID", "FAIL").when(blank(search_url), "FAIL").when(blank(url), "FAIL")
        .when(said("ssrf_blocked", "http_403", "cloudflare_detected", "captcha_detected"), "BLOCKED")
        .when(said("unsupported_webview", "unsupported_java_ajax", "unsupported_rhino_api", "unsupported_rule_syntax"), "UNSUPPORTED")
        .when(said("login_required") | F.coalesce(login == "needsLogin", F.lit(False)), "NEEDS_LOGIN")
        .when(F.size(stages) == 0, fast).when(clean, "PASS").when(found & failed, "PARTIAL_PASS").when(~passed, "FAIL").otherwise("PARTIAL_PASS")
    )
    risky = F.arrays_overlap(risks, F.array(*map(F.lit, ("FUTURE_TIMESTAMP", "complex_js_eval", "complex_js_dynamic"))))
    return F.when(first.isin("UNKNOWN", "PASS") & risky, "RISKY").otherwise(first)


def batch_reasons(structure: Column, search_url: Column, url: Column, reasons: Column) -> Column:
    front = F.when(structure == "STRUCTURE_INVALID", "structure_invalid").when(blank(search_url), "search_url_missing").when(blank(url), "book_source_url_missing")
    return F.concat(F.array_compact(F.array(front)), reasons)


def batch_summary(results: DataFrame) -> DataFrame:
    """(dimension, value, n) over status, failure reason, host, group and type of batch results."""
    counted = results.select("idx", F.inline(F.array(*[
        F.struct(F.lit(d).alias("dimension"), v.cast("string").alias("value")) for d, v in (
            ("total", F.lit("all")), ("status", F.col("status")), ("host", F.col("host")), ("group", F.coalesce(F.nullif("grp", F.lit("")), F.lit("(none)"))), ("type", F.coalesce(F.col("type").cast("string"), F.lit("undefined"))))])))
    reasons = results.select("idx", F.lit("reason").alias("dimension"), F.explode("reasons").alias("value"))
    return counted.unionByName(reasons).where("value is not null").groupBy("dimension", "value").agg(F.count("*").alias("n"))


def top_reasons(results: DataFrame, k: int = 10) -> DataFrame:
    """(reason, n): the k most frequent failure reasons of batch results."""
    return results.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(k)


#: Most redirects that are followed, and bytes of a body that are kept.
HOPS, BODY = 5, 262_144


def refused(url: str, resolve: Callable[[str], list[str]] | None = None) -> bool:
    """private_url() in a task, before each hop; resolve(host) -> addresses adds what names stand for."""
    host = hosts.host_text(url)
    if not host or host == "localhost" or host.endswith((".local", ".localhost")):
        return True
    for text in [host, *(resolve(host) if resolve else ())]:
        try:
            ip = ipaddress.ip_address(text)
        except ValueError:
            continue
        inner = ip if ip.version == 4 else ipaddress.ip_address(int(ip) % 2**32) if int(ip) >> 32 in (0, 0xFFFF) else None
        if any(ip in net for net in _PRIVATE6) if inner is None else any(int(inner) >> 32 - bits == base >> 32 - bits for base, bits in hosts.NETS4):
            return True
    return False


_PRIVATE6 = [ipaddress.ip_network(x) for x in ("fc00::/7", "fe80::/10")]


def refused_url(url: Column) -> Column:
    """urls.private_url(), with the few hosts that are no plain names looked at in Python: for plans that ask at
    several places, where the whole expression would be planned each time."""
    spot = F.lower(F.regexp_extract(url, hosts.SPOT, 1))
    plain = spot.rlike(hosts.PLAIN) & ~spot.rlike(hosts.NUMERIC)
    name = F.regexp_replace(spot, r"\.\z", "")
    odd = F.pandas_udf(lambda s: s.map(lambda u: u is not None and refused(u)).astype(bool), "boolean")
    return F.when(plain, (name == "localhost") | name.endswith(".localhost") | name.endswith(".local")).otherwise(odd(F.when(~F.coalesce(plain, F.lit(False)), F.coalesce(url, F.lit("")))))


def error_name(text: str) -> tuple[str, bool]:
    """(error of an exception's text, whether another attempt is worth it)."""
    low = text.lower()
    if "abort" in low or "timeout" in low or "timed out" in low:
        return "timeout", True
    if any(x in low for x in ("enotfound", "dns", "getaddrinfo", "name or service")):
        return "dns_failed", False
    if any(x in low for x in ("refused", "reset", "tls", "certificate", "ssl")):
        return "connection_error", False
    return "network_error", True


class HostPace:
    """At most `most` requests of a host at once, and `gap` seconds between the beginnings of two of them."""

    def __init__(self, most: int, gap: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.most, self.gap, self.clock, self.sleep = most, gap, clock, sleep
        self.lock, self.open, self.next = threading.Lock(), {}, {}

    @contextmanager
    def turn(self, host: str | None):
        with self.lock:
            seats = self.open.setdefault(host, threading.Semaphore(self.most))
        with seats:
            with self.lock:
                at = max(self.clock(), self.next.get(host, 0.0))
                self.next[host] = at + self.gap
            if (wait := at - self.clock()) > 0:
                self.sleep(wait)
            yield


def cut_bytes(text: str | None, most: int) -> str | None:
    """The characters of a text that fit whole into so many bytes of UTF-8."""
    raw = text.encode("utf-8", "surrogatepass") if text and len(text) * 4 > most else b""
    return raw[:most].decode("utf-8", "ignore") if len(raw) > most else text


def by_host(requests: DataFrame, tasks: int | None = None) -> DataFrame:
    """requests (idx, url, ...), dealt so that all of a host are in one task: a bound that a task keeps is then kept
    over all tasks.  A host with very many requests makes its task long; its own pace is what limits it anyway."""
    host = F.coalesce(F.lower(F.regexp_extract("url", hosts.SPOT, 1)), F.lit(""))
    n = tasks or 4 * requests.sparkSession.sparkContext.defaultParallelism
    return requests.withColumn("__host", host).repartition(n, "__host").drop("__host")


def fetch_with(requests: DataFrame, fetch: Callable[[str, str, str | None, dict], tuple[int, str | None, str | None, str | None]], workers: int = 16, retry: int = 1, resolve: Callable[[str], list[str]] | None = None,
               per_host: int | None = None, gap: float = 0.0, deadline: float | None = None, tasks: int | None = None) -> DataFrame:
    """(idx, url, method, body[, headers]) -> idx, url, status, content_type, page, error, hops, attempts, ms.

    fetch(url, method, body, headers) -> status, content type, body, location of a redirect; it raises
    where there is no answer.  Nothing in the library calls this without being handed `fetch`.  Private
    hosts are refused before each request, redirects (five at most) among them: after 301 and 302 as GET,
    after 307 and 308 with their method and body.  What may pass by itself is tried again, as long as
    `deadline` seconds have not gone by since the first attempt; then the error is `timeout`.  Requests of
    a task run `workers` at a time.

    per_host: most requests of one host at once, over all tasks: rows are dealt by host first, and each hop of a
    redirect waits for its turn at its own host within its task.  gap: seconds between two of a host.
    """
    has_headers = "headers" in requests.columns

    def one(row, pace: HostPace | None) -> tuple:
        began = time.monotonic()
        late = lambda: deadline is not None and time.monotonic() - began > deadline

        def attempt(url: str, method: str, body: str | None, headers: dict) -> tuple:
            for hops in range(HOPS + 1):
                if refused(url, resolve):
                    return (None, None, None, "ssrf_blocked", hops)
                if late():
                    return (None, None, None, "timeout", hops)
                with pace.turn(hosts.host_text(url)) if pace else nullcontext():
                    status, kind, page, location = fetch(url, method, body, headers)
                if status not in (301, 302, 307, 308) or not location or hops == HOPS:
                    return (status, kind, cut_bytes(page, BODY), None, hops)
                url = urljoin(url, location)
                if status in (301, 302):
                    method, body = "GET", None

        for tries in range(1, retry + 2):
            try:
                out = attempt(row["url"], row["method"], row["body"], dict(row["headers"] or ()) if has_headers else {})
                break
            except Exception as bad:  # whatever a fetcher raises is that request's error
                name, again = error_name(f"{type(bad).__name__} {bad}")
                out = (None, None, None, name, 0)
                if not again or late():
                    break
        return (row["idx"], row["url"], *out, tries, int((time.monotonic() - began) * 1000))

    def go(batches):
        pace = HostPace(per_host, gap) if per_host else None
        with ThreadPoolExecutor(workers) as pool:
            for b in batches:
                yield pd.DataFrame(list(pool.map(lambda r: one(r, pace), b.to_dict("records"))), columns=["idx", "url", "status", "content_type", "page", "error", "hops", "attempts", "ms"]).astype({"status": "Int32"})

    rows = by_host(requests, tasks) if per_host else requests
    return rows.mapInPandas(go, "idx long, url string, status int, content_type string, page string, error string, hops int, attempts int, ms long")


def connectivity(responses: DataFrame) -> DataFrame:
    """What fetch_with() found of each record's own url, as process() takes it: idx, connectivity,
    search_status (NOT_CHECKED), measured_respond_time."""
    return responses.select("idx", connectivity_status(F.col("status"), F.col("error")).alias("connectivity"), F.lit("NOT_CHECKED").alias("search_status"), F.when(F.col("error").isNull(), F.col("ms").cast("double")).alias("measured_respond_time"))


def search_probe(catalog: DataFrame, respond: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """catalog (flat columns, category) -> idx, search_status, asked: the status of each record's search.

    What the record itself settles never comes near a request; the others become rows (idx, url, method, body,
    headers) for `respond`, fetch_with() or stored_responses(), which gives idx, status, page, error for each.
    A record that respond() leaves out is unverified."""
    have = lambda c: F.col(c) if c in catalog.columns else F.lit(None).cast("string")
    rows = catalog.withColumns({c: have(c) for c in ("search_url", "explore_url", "login_url", "login_check_js", "js_lib", "header", "rs_list", "rs_check_key", "category")})
    judged = rows.select("idx", "url", "search_url", "header", "rs_list", judge.search_word(F.col("rs_check_key"), F.col("category")).alias("word"), search_precheck(F.col("url")).alias("settled"))
    settled = judged.where("settled is not null").select("idx", F.col("settled").alias("search_status"), F.lit(False).alias("asked"))
    open_ = judged.where("settled is null")
    r = urls.search_request(F.col("search_url"), F.col("url"), F.col("word"), F.lit(1))
    requests = open_.select("idx", "header", r.alias("r")).select("idx", "r.url", "r.method", "r.body", F.map_concat(urls.header_field(F.col("header")), F.map_filter("r.headers", lambda k, _: ~F.map_contains_key(urls.header_field(F.col("header")), k))).alias("headers"))
    said = respond(requests).select(F.col("idx").alias("of"), "status", "page", "error")
    told = open_.join(said, F.col("idx") == F.col("of"), "left").select("idx", search_status(F.col("status"), F.col("page"), F.col("error"), F.col("rs_list")).alias("search_status"), F.lit(True).alias("asked"))
    return settled.unionByName(told)


def stored_responses(pages: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A respond() that answers from a page store (url, status, body; one row a url), as far as a request would go out."""

    def respond(requests: DataFrame) -> DataFrame:
        store = pages.select(F.col("url").alias("purl"), "status", F.col("body").alias("page"))
        got = requests.select("idx", "url", refused_url(F.col("url")).alias("bad")).join(store, F.when(~F.col("bad"), F.col("url")) == F.col("purl"), "left")
        return got.select("idx", "status", "page", F.when(F.col("bad"), "ssrf_blocked").when(F.col("purl").isNull(), "network_error").alias("error"))

    return respond


def probed(sites: DataFrame, searches: DataFrame) -> DataFrame:
    """connectivity() of the records' sites with search_probe() of their searches, as process() takes both."""
    s = searches.select(F.col("idx").alias("of"), F.col("search_status").alias("searched"))
    both = sites.join(s, F.col("idx") == F.col("of"), "full")
    return both.select(F.coalesce("idx", "of").alias("idx"), F.coalesce("connectivity", F.lit("NOT_CHECKED")).alias("connectivity"), F.coalesce("searched", "search_status", F.lit("NOT_CHECKED")).alias("search_status"), "measured_respond_time")


def validate_mode(mode: str | None) -> str | None:
    """A mode of validation, whatever its case and white space; None for anything else."""
    m = mode.strip().lower() if isinstance(mode, str) else ""
    return m if m in vocab.VALIDATE_MODES else None
