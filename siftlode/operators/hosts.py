"""Hosts of http urls as browsers read them: numbers of any base, compressed IPv6, punycode; as expressions."""

from __future__ import annotations

import re
import socket
from collections.abc import Callable
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands between the scheme and the path, without user and port; brackets stay.
SPOT = r"(?is)^https?:[/\\]*(?:[^/?#\\]*@)?(\[[^\]/?#\\]*\]|[^/:?#\\]*)(?::[0-9]*)?(?:[/?#\\].*)?\z"
#: Names that need no more than lower case.
PLAIN = r"^[a-z0-9_.-]*[a-z][a-z0-9_-]*\.?\z"
NUMERIC = r"(^|\.)(?:[0-9]+|0x[0-9a-f]*)\.?\z"
FORBIDDEN = r"[\x00-\x20#/:<>?@\[\\\]^|%\x7F]"
# What the mapping of names makes plain dots of, and what it drops.
DOTS, DROPPED = "。．｡", "­​⁠﻿"
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).lower()


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), in which value is worked out once and named, however often it stands there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _digits(delta: Column, bias: Column) -> Column:
    """delta in punycode's variable-length digits, of which seven always do."""
    start = F.struct(delta.alias("q"), F.lit("").alias("out"), F.lit(False).alias("done"))

    def put(s, i):
        t = F.least(F.greatest(i * 36 - bias, F.lit(1)), F.lit(26)).cast("long")
        last = s["q"] < t
        d = F.when(last, s["q"]).otherwise(t + (s["q"] - t) % (36 - t))
        char = F.when(d < 26, F.char(d + 97)).otherwise(F.char(d + 22))
        q = F.when(last, s["q"]).otherwise(F.floor((s["q"] - t) / (36 - t)))
        return F.struct(F.when(s["done"], s["q"]).otherwise(q).cast("long").alias("q"), F.when(s["done"], s["out"]).otherwise(F.concat(s["out"], char)).alias("out"), (s["done"] | last).alias("done"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(8)), start, put, lambda s: s["out"])


def _bias(delta: Column, points: Column, first: Column) -> Column:
    d = F.floor(delta / F.when(first, F.lit(700)).otherwise(F.lit(2)))
    start = F.struct((d + F.floor(d / points)).cast("long").alias("d"), F.lit(0).cast("long").alias("k"))
    step = lambda s, _: F.struct(F.when(s["d"] > 455, F.floor(s["d"] / 35)).otherwise(s["d"]).cast("long").alias("d"), (s["k"] + F.when(s["d"] > 455, 36).otherwise(0)).cast("long").alias("k"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(6)), start, step, lambda s: (s["k"] + F.floor(s["d"] * 36 / (s["d"] + 38))).cast("long"))


def punycode(label: Column) -> Column:
    """Bootstring encoding of a label, without the prefix."""
    return let(F.transform(F.split(label, ""), lambda ch: F.ascii(ch).cast("long")), _bootstring)


def _bootstring(points: Column) -> Column:
    basic = F.filter(points, lambda c: c < 128)
    n0 = F.size(basic).cast("long")
    out0 = F.concat(F.array_join(F.transform(basic, F.char), ""), F.when(n0 > 0, "-").otherwise(""))
    zero = lambda v: F.lit(v).cast("long")
    start = F.struct(zero(128).alias("n"), zero(0).alias("delta"), zero(72).alias("bias"), n0.alias("h"), out0.alias("out"))

    def round_(s, m):
        inner0 = F.struct((s["delta"] + (m - s["n"]) * (s["h"] + 1)).alias("delta"), s["bias"].alias("bias"), s["h"].alias("h"), s["out"].alias("out"))

        def each(t, c):
            hit = c == m
            return F.struct(
                F.when(hit, 0).when(c < m, t["delta"] + 1).otherwise(t["delta"]).cast("long").alias("delta"), F.when(hit, _bias(t["delta"], t["h"] + 1, t["h"] == n0)).otherwise(t["bias"]).cast("long").alias("bias"),
                (t["h"] + F.when(hit, 1).otherwise(0)).cast("long").alias("h"), F.when(hit, F.concat(t["out"], _digits(t["delta"], t["bias"]))).otherwise(t["out"]).alias("out"))

        return F.aggregate(points, inner0, each, lambda t: F.struct((m + 1).alias("n"), (t["delta"] + 1).alias("delta"), t["bias"].alias("bias"), t["h"].alias("h"), t["out"].alias("out")))

    return F.aggregate(F.array_sort(F.array_distinct(F.filter(points, lambda c: c >= 128))), start, round_, lambda s: s["out"])


def ascii_name(name: Column) -> Column:
    """A name in lower case with its labels in punycode where they need it."""
    label = lambda x: F.when(x.rlike(r"[^\x00-\x7F]"), F.concat(F.lit("xn--"), punycode(x))).otherwise(x)
    mapped = F.translate(F.lower(F.translate(name, WIDE + DOTS, NARROW + "...")), DROPPED, "")
    return let(mapped, lambda m: F.when(m.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(F.split(m, r"\."), label), ".")).otherwise(m))


def ipv4_number(host: Column) -> Column:
    """The address that a numeric host stands for: one to four numbers, decimal, octal (0...) or hexadecimal (0x...),
    the last of which fills what is left; null if it is none."""

    def value(p):
        digits = F.regexp_replace(p, "^0x0*|^0+(?=[0-9])", "")
        hexa, octal = p.startswith("0x"), p.rlike("^0[0-9]")
        return let(digits, lambda d: F.when(
            F.when(hexa, d.rlike(r"^[0-9a-f]{0,8}\z")).when(octal, d.rlike(r"^[0-7]{1,11}\z")).otherwise(d.rlike(r"^[0-9]{1,10}\z")),
            F.when(d == "", "0").when(hexa, F.conv(d, 16, 10)).when(octal, F.conv(d, 8, 10)).otherwise(d).cast("long")))

    def number(values):
        n, last = F.size(values), F.element_at(values, -1)
        head = F.slice(values, 1, n - 1)
        room = F.element_at(F.array(*[F.lit(256**k) for k in (4, 3, 2, 1)]), n)
        good = ~F.exists(values, lambda v: v.isNull()) & F.forall(head, lambda v: v < 256) & (last < room)
        weighed = F.transform(head, lambda v, i: v * F.element_at(F.array(*[F.lit(256**k) for k in (3, 2, 1)]), i + 1))
        return F.when(n <= 4, F.when(good, F.aggregate(weighed, F.lit(0).cast("long"), lambda s, x: s + x) + last))

    return let(F.transform(F.split(F.regexp_replace(host, r"\.\z", ""), r"\."), value), number)


def dotted(number: Column) -> Column:
    return F.when(number.isNotNull(), let(number, lambda n: F.concat_ws(".", *[(F.shiftright(n, s) % 256).cast("string") for s in (24, 16, 8, 0)])))


def ipv6_groups(text: Column) -> Column:
    """The eight numbers of an IPv6 address without brackets; null if it is none."""
    v4 = lambda low: F.regexp_extract(low, r":((?:(?:0|[1-9][0-9]{0,2})\.){3}(?:0|[1-9][0-9]{0,2}))\z", 1)
    two = lambda n: F.concat_ws(":", F.lower(F.hex(F.shiftright(n, 16))), F.lower(F.hex(n.bitwiseAND(F.lit(65535)))))
    inner = lambda low, v: F.when(v == "", low).otherwise(F.concat(F.regexp_replace(low, r"[0-9.]+\z", ""), let(ipv4_number(v), two)))
    of = lambda c: F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ":", -1))

    def spread(halves):
        left, right = of(F.get(halves, F.lit(0))), of(F.get(halves, F.lit(1)))
        given = F.size(left) + F.size(right)
        whole = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(8 - given, F.lit(0))), right)
        return F.when(F.size(halves) == 1, left).when((F.size(halves) == 2) & (given <= 7), whole)

    def numbers(groups):
        good = (F.size(groups) == 8) & F.forall(groups, lambda x: x.rlike(r"^[0-9a-f]{1,4}\z"))
        return F.when(good, F.transform(groups, lambda x: F.conv(x, 16, 10).cast("int")))

    full = let(F.lower(text), lambda low: let(v4(low), lambda v: inner(low, v)))
    return let(let(F.split(full, "::", -1), spread), numbers)


def ipv6_text(groups: Column) -> Column:
    """Lower-case, without leading zeros, the first longest run of two zeros or more as `::`."""
    patterns = [rf"(?:^|:)0(?::0){{{k - 1}}}(?::|\z)" for k in range(2, 9)]

    def cut(plain):
        out = plain
        for p in patterns:  # the longest stands outermost and is asked first
            at = F.regexp_instr(plain, F.lit(p))
            out = F.when(plain.rlike(p), F.concat(F.substr(plain, F.lit(1), at - 1), F.lit("::"), F.substr(plain, at + F.length(F.regexp_substr(plain, F.lit(p)))))).otherwise(out)
        return out

    return let(F.array_join(F.transform(groups, lambda x: F.lower(F.hex(x))), ":"), cut)


def web_host(url: Column) -> Column:
    """Host of an http url, as a browser reads it; null where it would refuse the url.

    Names are in lower case, in punycode where they are not ASCII, without a final dot; numbers in any base are
    dotted; IPv6 addresses are compressed, without brackets.  Of the mapping of international names only case,
    full-width letters, dots and invisible marks are done."""
    clean = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+\z", ""), r"[\t\n\r]", "")
    return let(F.lower(F.nullif(F.regexp_extract(clean, SPOT, 1), F.lit(""))), of_spot)


def of_spot(spot: Column) -> Column:
    """web_host() of what stands in a url where its host does, in lower case."""
    decoded = F.coalesce(F.try_url_decode(F.replace(spot, F.lit("+"), F.lit("%2B"))), spot)
    address = let(ipv6_groups(F.regexp_replace(spot, r"^\[|\]\z", "")), lambda g: F.when(g.isNotNull(), ipv6_text(g)))
    named = let(ascii_name(F.when(spot.contains("%"), decoded).otherwise(spot)), lambda n: F.when(n.rlike(NUMERIC), dotted(ipv4_number(n))).when(~n.rlike(FORBIDDEN), n))
    host = F.when(spot.rlike(PLAIN) & ~spot.rlike(NUMERIC), spot).when(spot.startswith("["), address).otherwise(named)
    return F.nullif(F.regexp_replace(host, r"\.\z", ""), F.lit(""))


def private_address(host: Column) -> Column:
    """Of a web_host(): whether it is an address that is unspecified, loopback, private, link-local or unique-local,
    also one in an IPv6 address that maps or contains an IPv4 one.  Names are no addresses: false."""
    within = lambda n: F.coalesce(reduce(lambda a, b: a | b, [F.shiftright(n, 32 - bits) == (base >> (32 - bits)) for base, bits in NETS4]), F.lit(False))

    def of_groups(g):
        first = F.get(g, F.lit(0))
        contained = F.forall(F.slice(g, 1, 5), lambda x: x == 0) & F.get(g, F.lit(5)).isin(0, 65535)
        return F.when(contained, within(F.get(g, F.lit(6)).cast("long") * 65536 + F.get(g, F.lit(7)))).otherwise((F.shiftright(first, 9) == 0xFC00 >> 9) | (F.shiftright(first, 6) == 0xFE80 >> 6))

    return F.coalesce(F.when(host.rlike(r"^[0-9]+(\.[0-9]+){3}\z"), let(ipv4_number(host), within)).when(host.contains(":"), let(ipv6_groups(host), of_groups)), F.lit(False))


#: (address, bits): 0/8, 10/8, 127/8, 169.254/16, 172.16/12, 192.168/16.
NETS4 = ((0, 8), (10 << 24, 8), (127 << 24, 8), (169 << 24 | 254 << 16, 16), (172 << 24 | 16 << 16, 12), (192 << 24 | 168 << 16, 16))


def host_text(url: str) -> str | None:
    """web_host() of one url, in a task that is about to fetch it."""
    clean = re.sub(r"[\t\n\r]", "", url.strip("".join(map(chr, range(33)))))
    m = re.match(SPOT.replace(r"\z", r"\Z"), clean)
    spot = m[1].lower() if m else ""
    if spot.startswith("["):
        try:
            raw = socket.inet_pton(socket.AF_INET6, spot[1:-1])
        except OSError:
            return None
        plain = ":".join(f"{raw[i] << 8 | raw[i + 1]:x}" for i in range(0, 16, 2))
        runs = (re.search(rf"(?:^|:)0(?::0){{{k - 1}}}(?::|$)", plain) for k in range(8, 1, -1))
        run = next((r for r in runs if r), None)
        return f"{plain[: run.start()]}::{plain[run.end() :]}" if run else plain
    name = unquote(spot, errors="replace").translate(str.maketrans(WIDE + DOTS, NARROW + "...")).lower().translate({ord(c): None for c in DROPPED})
    name = ".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in name.split("."))
    if re.search(NUMERIC.replace(r"\z", r"\Z"), name):
        name = re.sub(r"(^|\.)0x(?=\.|$)", r"\g<1>0", name.removesuffix("."))
        try:
            return socket.inet_ntoa(socket.inet_aton(name)) if re.fullmatch(r"[0-9a-fx.]+", name) else None
        except OSError:
            return None
    return None if re.search(FORBIDDEN, name) else name.removesuffix(".") or None
