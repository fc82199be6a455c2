"""Url normalisation: decorations, status, host and keys, as expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlode.functions import vocab
from siftlode.functions.plan import barrier
from siftlode.functions.text import CJK, NOT_S, S, encode_component, matches, sub, trim
from siftlode.operators import hosts

HTTP = r"(?i)^https?://.+"
DOMAIN = r"^[a-zA-Z0-9][-a-zA-Z0-9.]*\.[a-zA-Z]{2,}(:[0-9]+)?(/.*)?\z"
AUTHORITY = r"(?i)^https?://(?:[^/?#@]*@)?([^/:?#\\]+)"
#: Codes in {{...}} that are worked out: (page - 1) * 20 + 1, page * 20 + 1, 20 * (page - 1).
PAGE_SHIFTED = r"^\(\s*page\s*([+-])\s*([0-9]{1,9})\s*\)\s*(?:\*\s*([0-9]{1,9}))?\s*(?:([+-])\s*([0-9]{1,9}))?\z"
PAGE_TIMES = r"^page\s*(?:\*\s*([0-9]{1,9}))?\s*(?:([+-])\s*([0-9]{1,9}))?\z"
TIMES_PAGE = r"^([0-9]{1,9})\s*\*\s*\(\s*page\s*([+-])\s*([0-9]{1,9})\s*\)\z"


#: What is left of a url when a trailing CJK note, #note, @maintainer and punctuation are gone.
BASE = f"(?s)^{S}*(.*?){S}*[;；]*{S}*[,，。；;！!？?、]*{S}*(?:@{NOT_S}*)?{S}*(?:#{NOT_S}*)?{S}*[{CJK}]*{S}*\\z"


def strip_decorations(raw: Column) -> Column:
    """Trailing CJK notes, #notes, @maintainers and punctuation go; null for a blank url; the trimmed
    url itself if nothing would be left."""
    return F.coalesce(F.nullif(F.regexp_extract(raw, BASE, 1), F.lit("")), F.nullif(trim(raw), F.lit("")))


def is_http(c: Column) -> Column:
    return matches(trim(c), HTTP)


def looks_like_domain(c: Column) -> Column:
    return matches(c, DOMAIN)


def no_slash(c: Column) -> Column:
    return sub(c, r"/+\z")


def normalize_host(host: Column) -> Column:
    """Lower case, without port and without the first prefix that only names a device or service."""
    h = sub(trim(F.lower(host)), r":.*\z")
    return F.when(host != "", sub(h, "^(?:" + "|".join(re.escape(p) for p in vocab.HOST_PREFIXES) + ")"))


def normalize_url(raw: Column, candidate: Column | None = None) -> Column:
    """struct(url, host, normalized_host, url_status, url_warnings, candidate); candidate: the stripped
    url where it is a column already, which with_url() sees to."""
    c = strip_decorations(raw) if candidate is None else candidate
    http, domain = matches(c, HTTP), looks_like_domain(c)
    full = F.when(http, c).otherwise(F.concat(F.lit("https://"), c))
    host = F.nullif(F.lower(F.regexp_extract(full, AUTHORITY, 1)), F.lit(""))
    plain = sub(F.lower(c), f"{S}+", "_")
    none = F.lit(None).cast("string")

    def out(url, host, norm, status, warning=None):
        return F.struct(url.alias("url"), host.alias("host"), norm.alias("normalized_host"), F.lit(status).alias("url_status"), (F.array(F.lit(warning)) if warning else F.array().cast("array<string>")).alias("url_warnings"), c.alias("candidate"))

    return (
        F.when(c.isNull(), out(none, none, none, "INVALID_URL"))
        .when(http & host.isNull(), out(none, none, none, "INVALID_URL", "Failed to parse valid-looking HTTP URL"))
        .when(http, out(no_slash(c), host, normalize_host(host), "VALID_HTTP"))
        .when(domain, out(no_slash(full), host, normalize_host(host), "NON_HTTP_LOOKS_LIKE_DOMAIN"))
        .otherwise(out(c, plain, plain, "NON_HTTP_SOURCE"))
    )


def with_url(df: DataFrame, url: str = "url", into: str = "norm") -> DataFrame:
    """df + struct into, by way of a column for the stripped url so that it is worked out once a row."""
    return barrier(df.withColumn("__candidate", strip_decorations(F.col(url))).withColumn(into, normalize_url(F.col(url), F.col("__candidate")))).drop("__candidate")


def host_key(raw: Column) -> Column:
    return normalize_url(raw)["normalized_host"]


def url_key(raw: Column, candidate: Column | None = None) -> Column:
    """Key of equal urls: without trailing slashes; other identifiers in lower case."""
    c = strip_decorations(raw) if candidate is None else candidate
    http = matches(c, r"(?i)^https?://")
    return F.when(http, no_slash(c)).when(looks_like_domain(c), no_slash(F.concat(F.lit("https://"), c))).otherwise(trim(F.lower(c)))


def private_ip(ip: Column) -> Column:
    """Literal unspecified, loopback, private, link-local and unique-local addresses, in any form that a browser
    reads as one; other text is none."""
    low = F.lower(ip)
    return hosts.private_address(hosts.of_spot(F.when(low.contains(":") & ~low.startswith("["), F.concat(F.lit("["), low, F.lit("]"))).otherwise(low)))


def private_host(host: Column) -> Column:
    """Of a hosts.web_host(): names and addresses of this machine or its network; names are not looked up."""
    return F.coalesce((host == "localhost") | host.endswith(".localhost") | host.endswith(".local"), F.lit(False)) | hosts.private_address(host)


def private_url(url: Column) -> Column:
    """A url that must not be fetched: it has no host that a browser would go to, or a private one."""
    return hosts.let(hosts.web_host(url), lambda host: host.isNull() | private_host(host))


def has_template_js(c: Column) -> Column:
    return matches(c, r"\{\{.*?(\?|\.length|\.substring|\.slice|\.replace|&&|\|\|).*?\}\}")


def template_value(code: Column, key: Column, page: Column, base: Column) -> Column:
    """Text for the code inside {{...}}: the keyword (encoded, or as it is in upper or lower case), the
    page and sums of it, the base.  Notes (#...) and all other scripts give nothing; none is run."""
    c = trim(code)
    part = lambda pattern, i, default: F.coalesce(F.nullif(F.regexp_extract(c, pattern, i), F.lit("")).cast("long"), F.lit(default))
    signed = lambda pattern, i: F.when(F.regexp_extract(c, pattern, i) == "-", -part(pattern, i + 1, 0)).otherwise(part(pattern, i + 1, 0))
    value = (
        F.when(c.isin("key", "keyword", "encodeURIComponent(key)", "encodeURIComponent(keyword)"), encode_component(key))
        .when(c == "key.toUpperCase()", F.upper(key)).when(c == "key.toLowerCase()", F.lower(key)).when(c.isin("source.bookSourceUrl", "baseUrl"), base)
        .when(c.rlike(PAGE_SHIFTED), ((page + signed(PAGE_SHIFTED, 1)) * part(PAGE_SHIFTED, 3, 1) + signed(PAGE_SHIFTED, 4)).cast("string"))
        .when(c.rlike(PAGE_TIMES), (page * part(PAGE_TIMES, 1, 1) + signed(PAGE_TIMES, 2)).cast("string"))
        .when(c.rlike(TIMES_PAGE), (part(TIMES_PAGE, 1, 1) * (page + signed(TIMES_PAGE, 2))).cast("string"))
    )
    return F.coalesce(value, F.lit(""))


def fill_template(template: Column, key: Column, page: Column, base: Column) -> Column:
    """template with every {{...}} replaced by its template_value()."""
    codes = F.regexp_extract_all(template, F.lit(r"(?s)\{\{(.*?)\}\}"), F.lit(1))
    texts = F.split(template, r"(?s)\{\{.*?\}\}", -1)
    return F.array_join(F.zip_with(texts, codes, lambda t, c: F.concat(t, template_value(c, key, page, base))), "")


def search_request(template: Column, base: Column, keyword: Column, page: Column) -> Column:
    """struct(url, method, body, charset, headers) of a search template `url[,{options}]`.

    {{...}} is filled by fill_template(); <a,b,c> is the page's entry, the last one beyond it; a path is
    put behind the base's origin.  Headers that are never sent on are left out.
    """
    two = r"(?s)\A(.*?),\s*(\{(?!\{).*\})\s*\z"  # a comma before {{ belongs to the url
    url = F.coalesce(F.nullif(F.regexp_extract(template, two, 1), F.lit("")), template)
    options = F.from_json(F.nullif(F.regexp_extract(template, two, 2), F.lit("")), "method string, body string, charset string, headers map<string,string>")
    fill = lambda c: fill_template(c, keyword, page, base)
    pages = F.split(F.regexp_extract(url, "<([^<>]*)>", 1), ",")
    one = trim(F.element_at(pages, F.least(page, F.size(pages))))
    url = fill(F.when(url.rlike("<[^<>]*>"), F.concat(F.regexp_extract(url, "^([^<]*)<", 1), one, F.regexp_extract(url, ">([^<>]*)\\z", 1))).otherwise(url))
    origin = F.regexp_extract(base, "(?i)^(https?://[^/?#]+)", 1)
    url = F.when(matches(url, "(?i)^https?://"), url).when(url.startswith("//"), F.concat(F.lit("https:"), url)).when(url.startswith("/"), F.concat(origin, url)).when(looks_like_domain(url), F.concat(F.lit("https://"), url)).otherwise(F.concat(origin, F.lit("/"), url))
    method = F.upper(F.coalesce(options["method"], F.lit("GET")))
    body = F.coalesce(fill(options["body"]), F.when(method == "POST", F.concat(F.lit("searchkey="), encode_component(keyword))))
    return F.struct(url.alias("url"), method.alias("method"), body.alias("body"), options["charset"].alias("charset"), safe_headers(F.coalesce(options["headers"], F.create_map().cast("map<string,string>"))).alias("headers"))


def safe_headers(headers: Column) -> Column:
    return F.map_filter(headers, lambda k, _: ~F.lower(k).isin(*vocab.UNSAFE_HEADERS))


def header_field(header: Column) -> Column:
    """Headers that a record's `header` field (the text of a JSON object) asks for and that may be sent;
    none where it is null or cannot be read."""
    return safe_headers(F.coalesce(F.from_json(header, "map<string,string>"), F.create_map().cast("map<string,string>")))
