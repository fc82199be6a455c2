"""String expressions with the semantics of the web platform, as Spark columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftlode.functions import vocab

#: White space of the web platform, inside a character class.
WS = r"\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
S, NOT_S = f"[{WS}]", f"[^{WS}]"
CJK = r"\x{4e00}-\x{9fff}"
EMOJI = f"[{vocab.PICTOGRAPHIC}{vocab.LEGACY_EMOJI}{vocab.INVISIBLE}]"


def sub(c: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(to))


def trim(c: Column) -> Column:
    return sub(c, f"^{S}+|{S}+\\z")


def squeeze(c: Column) -> Column:
    """White space runs become one space; none at either end."""
    return trim(sub(c, f"{S}+", " "))


def blank(c: Column) -> Column:
    return F.coalesce(trim(c) == "", F.lit(True))


def filled(c: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(c != "", F.lit(False))


def matches(c: Column, pattern: str) -> Column:
    """rlike that is false for null."""
    return F.coalesce(c.rlike(pattern), F.lit(False))


def words_re(words: tuple[str, ...]) -> str:
    return "|".join(re.escape(w.lower()) for w in words)


def ascii_bounded(pattern: str) -> str:
    """\\b as the web platform has it: an edge of ASCII word characters."""
    parts = pattern.split(r"\b")
    return f"(?<![A-Za-z0-9_]){parts[1]}(?![A-Za-z0-9_])" if len(parts) == 3 else pattern


def encode_component(c: Column) -> Column:
    """Percent-encoding that keeps A-Z a-z 0-9 - _ . ! ~ * ' ( )."""
    out = F.url_encode(c)
    for coded, plain in (("+", "%20"), ("%7E", "~"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return out


def html_escape(c: Column) -> Column:
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def csv_field(c: Column) -> Column:
    """A field that no spreadsheet takes for a formula, quoted where it must be."""
    c = F.coalesce(c.cast("string"), F.lit(""))
    c = F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)
    return F.when(c.rlike(r'[,"\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def csv_audit_field(c: Column) -> Column:
    """The audit files' field: quoted for commas and quotes only."""
    c = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(c.rlike('[,"]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def mask_secret(c: Column) -> Column:
    return F.concat(F.substring(c, 1, 6), F.lit("***[REDACTED]"))


def natural_key(c: Column) -> Column:
    """A key that sorts a text as people do: case aside, with its numbers by their values.

    Each run of digits has its length, without leading zeros, in front; so plain comparison orders numbers of
    any length, and the key serves range partitions as well as sorts."""
    runs = F.regexp_extract_all(F.lower(c), F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    number = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike("^[0-9]"), F.concat(F.lpad(F.length(number(x)).cast("string"), 5, "0"), number(x))).otherwise(x)), "")


def web_regex(pattern: str) -> str | None:
    """A pattern of the web platform in the words that Java's and Python's engines read alike; None if there are none.

    Dots, \\s, \\d, \\w, \\b and $ differ between the three, so they become classes and look-arounds.  Named groups,
    look-behind, properties, inline flags and possessive quantifiers are not translated."""
    word, space, out, i, inside, quantified = "A-Za-z0-9_", r" \t-\r\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff", [], 0, False, False
    while i < len(pattern):
        ch, rest = pattern[i], pattern[i + 1 : i + 5]
        was, quantified = quantified, False
        if ch == "\\":
            e, i = rest[:1], i + 2
            if e in ("d", "w", "s"):
                of = {"d": "0-9", "w": word, "s": space}[e]
                out.append(of if inside else f"[{of}]")
            elif e in ("D", "W", "S") and not inside:
                out.append("[^" + {"D": "0-9", "W": word, "S": space}[e] + "]")
            elif e == "b" and not inside:
                out.append(f"(?:(?<![{word}])(?=[{word}])|(?<=[{word}])(?![{word}]))")
            elif e in ("n", "r", "t", "f") or (e.isdigit() and e != "0" and not inside):
                out.append("\\" + e)
            elif e == "v":
                out.append(r"\u000b")
            elif (e == "u" and re.fullmatch("[0-9A-Fa-f]{4}", pattern[i : i + 4])) or (e == "x" and re.fullmatch("[0-9A-Fa-f]{2}", pattern[i : i + 2])):
                n = 4 if e == "u" else 2
                out.append("\\" + e + pattern[i : i + n])
                i += n
            elif e and e.isascii() and not e.isalnum():
                out.append("\\" + e)
            else:
                return None
            continue
        if inside:
            inside = ch != "]"
            out.append("\\" + ch if ch in "[&~|" else ch)
        elif ch == "[":
            inside = True
            if rest[:1] == "]" or rest[:2] == "^]":
                return None
            out.append("[^" if rest[:1] == "^" else "[")
            i += rest[:1] == "^"
        elif ch == "(":
            if rest[:1] == "?" and rest[1:2] not in (":", "=", "!"):
                return None
            out.append(ch)
        elif ch == ".":
            out.append(r"[^\n\r\u2028\u2029]")
        elif ch == "$":
            out.append(r"(?![\s\S])")
        elif ch == "{" and (m := re.match(r"\{\d+(,\d*)?\}", pattern[i:])):
            out.append(m[0])
            i += len(m[0]) - 1
            quantified = True
        elif ch in "{}]":
            out.append("\\" + ch)
        elif ch in "*+?":
            if ch == "+" and was:
                return None
            out.append(ch)
            quantified = not (ch == "?" and was)
        else:
            out.append(ch)
        i += 1
    text = "".join(out)
    try:
        re.compile(text)
    except (re.error, OverflowError):
        return None
    return None if inside else text


def replacement(to: str, groups: int) -> list[str | int]:
    """What a replacement of the web platform is made of: texts, and numbers of groups (0: the match)."""
    out: list[str | int] = []
    for m in re.finditer(r"\$(?:\$|&|[1-9])|[^$]+|\$", to):
        x = m[0]
        out.append("$" if x == "$$" else 0 if x == "$&" else int(x[1]) if re.fullmatch(r"\$[1-9]", x) and int(x[1]) <= groups else x)
    return out


def regex_replace(c: Column, pattern: str, to: str, first: bool = False) -> Column:
    """##pattern##replacement of a rule: every match, or the first one; $1 names a group, $& the match.

    A pattern that web_regex() does not translate is left to Java as it is."""
    p = web_regex(pattern) or pattern
    n = re.compile(p).groups
    shift = 2 if first else 0  # behind two groups of our own
    after = "".join(f"${x + shift}" if isinstance(x, int) else re.sub(r"[\\$]", r"\\\g<0>", x) for x in replacement(to, n))
    if not first:
        return sub(c, p, after)
    return sub(c, rf"(?s)\A(.*?)({p})(.*)\z", "$1" + after + f"${n + 3}")


def regex_extract(c: Column, patterns: tuple[str, ...], group: int = 0) -> Column:
    """Matches of the last pattern, each pattern looking at what the one before found, a match a line;
    none as soon as a pattern finds nothing.  A group that a pattern lacks, or that took no part, is the whole match."""
    for p in patterns:
        g = group if re.compile(p).groups >= group else 0
        found = F.regexp_extract_all(c, F.lit(p), F.lit(g))
        if g:
            found = F.zip_with(found, F.regexp_extract_all(c, F.lit(p), F.lit(0)), lambda x, whole: F.when(x == "", whole).otherwise(x))
        c = F.when(F.size(found) > 0, F.array_join(found, "\n"))
    return F.filter(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: x != "")
