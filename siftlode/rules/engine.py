"""Rule strings: read once into groups of steps, run over documents and over items of a list."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from decimal import Decimal
from functools import lru_cache
from typing import Any
from urllib.parse import urljoin

import regex

from siftlode.functions.text import replacement, web_regex
from siftlode.rules.dom import Node, parse
from siftlode.rules.select import BadRule, css, css_is, jsonpath, xpath

GETTERS = ("text", "alltext", "html", "outerhtml", "href", "src", "val")
SCRIPT = re.compile(r"<js>|@js:|java\.|eval\(|WebView", re.I)
DOMAIN = re.compile(r"[a-zA-Z0-9][-a-zA-Z0-9.]*\.[a-zA-Z]{2,}(:\d+)?(/.*)?")


@dataclass(frozen=True)
class Step:
    """kind: css, xpath, json, get (an attribute or text), tag, index, put, take."""

    kind: str
    value: str


@dataclass(frozen=True)
class Group:
    """connector: how its values join those before it (&& all, || if none yet, %% in turn)."""

    connector: str
    steps: tuple[Step, ...]
    replace: tuple[tuple[str, str, bool], ...] = ()


def _split(rule: str) -> list[tuple[str, str]]:
    """(connector before, part) at && || %% outside braces, brackets and quotes."""
    out, depth, quote_, part, mark, i = [], 0, "", "", "", 0
    while i < len(rule):
        ch, two = rule[i], rule[i : i + 2]
        if quote_:
            quote_ = "" if ch == quote_ else quote_
        elif ch in "\"'":
            quote_ = ch
        elif ch in "{[(":
            depth += 1
        elif ch in "}])":
            depth -= 1
        elif depth <= 0 and two in ("&&", "||", "%%"):
            out.append((mark, part))
            mark, part, i = two, "", i + 2
            continue
        part += ch
        i += 1
    return [(m, p.strip()) for m, p in [*out, (mark, part)]]


def _step(text: str) -> Step:
    low = text.lower()
    if re.fullmatch(r"!-?\d+", text):
        return Step("index", text[1:])
    if low.startswith("tag:"):
        return Step("tag", low[4:].strip())
    if low in GETTERS:
        return Step("get", low)
    if low.startswith("css:"):
        return Step("css", text[4:].strip())
    if low.startswith("put:"):
        return Step("put", text[4:].strip(" {}"))
    if low.startswith("get:"):
        return Step("take", text[4:].strip(" {}"))
    return Step("css", text)


def _steps(text: str) -> tuple[Step, ...]:
    low = text.lower()
    if SCRIPT.search(text):
        raise BadRule("unsupported_rhino_api")
    if low.startswith("@xpath:"):
        return (Step("xpath", text[7:].strip()),)
    if low.startswith("@json:"):
        return (Step("json", text[6:].strip()),)
    if text.startswith("/"):
        return (Step("xpath", text),)
    if text.startswith(("$.", "$[", "$..")):
        return (Step("json", text),)
    parts, depth, part = [], 0, ""
    for ch in text:
        depth += (ch in "[({") - (ch in "])}")
        if ch == "@" and depth <= 0:
            parts.append(part)
            part = ""
        else:
            part += ch
    out = []
    for p in (x.strip() for x in [*parts, part]):
        if p and (m := re.fullmatch(r"(.*?\S)\s*(!-?\d+)", p)):
            out += [_step(m[1]), _step(m[2])]
        elif p:
            out.append(_step(p))
    return tuple(out)


@lru_cache(8192)
def read_rule(rule: str) -> tuple[Group, ...]:
    """The groups of a rule; BadRule if it needs a script or cannot be read."""
    out = []
    for mark, part in _split(rule.strip()):
        pieces = part.split("##")
        subs = ()
        if len(pieces) > 1:
            first = len(pieces) > 3
            subs = ((pieces[1], pieces[2] if len(pieces) > 2 else "", first),)
        if pieces[0].strip() or subs:
            out.append(Group(mark, _steps(pieces[0].strip()), subs))
    return tuple(out)


def number_text(x: int | float) -> str:
    """A number as the web platform writes it; whole numbers of up to 38 digits keep them all."""
    if isinstance(x, int) and abs(x) < 10**38:
        return str(x)
    x = float(x)
    if x == int(x) and abs(x) < 1e21:
        return str(int(Decimal(repr(x))))
    if 1e-6 <= abs(x) < 1e21:
        return format(Decimal(repr(x)), "f")
    mantissa, _, power = repr(x).partition("e")
    return f"{mantissa.removesuffix('.0')}e{power[0]}{power[1:].lstrip('0')}"


def text_of(x: Any) -> str:
    if isinstance(x, Node):
        return x.text().strip()
    if isinstance(x, str):
        return x
    if isinstance(x, (dict, list)):
        return json.dumps(x, ensure_ascii=False, separators=(",", ":"))
    return "" if x is None else str(x).lower() if isinstance(x, bool) else number_text(x)


def kind_of(x: Any) -> str:
    return "element" if isinstance(x, Node) else "object" if isinstance(x, (dict, list)) else "number" if isinstance(x, (int, float)) and not isinstance(x, bool) else "string"


def _get(x: Any, name: str) -> str | None:
    if isinstance(x, Node):
        if name in ("text", "alltext"):
            return x.text().strip()
        if name in ("html", "outerhtml"):
            return x.html()
        return x.attrs.get("value" if name == "val" else name)
    if isinstance(x, dict) and name in ("href", "src"):
        return next((text_of(x[k]) for k in ("url", "bookUrl", "href", "src") if x.get(k)), None)
    return text_of(x)


#: Seconds that one pattern of a rule may take on one text; beyond them the text stays as it is.
PATTERN_S = 1.0


@lru_cache(4096)
def _pattern(pattern: str, to: str) -> tuple[Any, list] | None:
    try:
        p = regex.compile(web_regex(pattern) or pattern)
    except regex.error:
        return None
    return p, replacement(to, p.groups)


def replace(text: str, subs: tuple[tuple[str, str, bool], ...]) -> str:
    for pattern, to, first in subs:
        if found := _pattern(pattern, to):
            p, parts = found
            try:
                text = p.sub(lambda m, parts=parts: "".join(x if isinstance(x, str) else m[x] or "" for x in parts), text, count=1 if first else 0, timeout=PATTERN_S)
            except TimeoutError:
                pass
    return text


def _once(pairs: list[tuple[str, Any]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a key stands twice in an object")
    return out


def _no_number(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


#: Stands for the data of a body that is not JSON.
UNREAD = object()


class Document:
    """A body that is parsed at most once each way."""

    def __init__(self, body: str | None, open_references: bool = True):
        self.body = body or ""
        self.open_references = open_references
        self._root: Node | None = None
        self._data: Any = ...

    def root(self) -> Node:
        if self._root is None:
            self._root = parse(self.body, self.open_references)
        return self._root

    def data(self) -> Any:
        if self._data is ...:
            try:
                self._data = json.loads(self.body, object_pairs_hook=_once, parse_constant=_no_number)
            except (ValueError, RecursionError):
                self._data = UNREAD
        return self._data


def _run(steps: tuple[Step, ...], start: list, doc: Document, known: dict[str, str]) -> list:
    at = start
    for s in steps:
        if s.kind == "css":
            pool = [x if isinstance(x, Node) else doc.root() for x in at]
            found = [n for x in pool for n in css(x, s.value)]
            if not found:
                found = [x for x in pool if x.tag != "#document" and css_is(x, s.value)]
            at = list({id(n): n for n in found}.values())
        elif s.kind == "xpath":
            at = [y for x in at for y in xpath(x if isinstance(x, Node) else doc.root(), s.value)]
        elif s.kind == "json":
            pool = [doc.data() if isinstance(x, (Node, Document)) else x for x in at]
            at = [y for x in pool if x is not UNREAD for y in jsonpath(x, s.value)]
        elif s.kind == "index":
            i = int(s.value)
            at = [at[i]] if -len(at) <= i < len(at) else []
        elif s.kind == "tag":
            at = [c for x in at if isinstance(x, Node) for c in x.elements() if c.tag == s.value]
        elif s.kind == "put":
            known[s.value] = text_of(at[0]) if at else ""
        elif s.kind == "take":
            at = [known[s.value]] if s.value in known else []
        else:
            at = [v for x in at for v in [_get(doc.root() if isinstance(x, Document) else x, s.value)] if v]
        if not at:
            break
    return at


def run(rule: str | None, doc: Document, scope: Any = None) -> list:
    """Values of a rule over a document, or over one item of a list.

    && joins lists, || takes the first that is not empty and does not run the rest, %% takes turns.
    """
    if not rule or not rule.strip():
        return []
    out: list = []
    known: dict[str, str] = {}
    for g in read_rule(rule):
        if g.connector == "||" and out:
            continue
        start = [doc if scope is None else scope]
        steps = g.steps
        if isinstance(scope, (dict, list)) and steps and steps[0].kind == "css":
            name = steps[0].value
            hit = [scope[name]] if isinstance(scope, dict) and name in scope else jsonpath(scope, name if name.startswith("$") else f"$.{name}")
            start, steps = hit, steps[1:]
        found = _run(steps, start, doc, known) if start else []
        found = [doc.body if isinstance(x, Document) else x for x in found]
        if g.replace:
            found = [replace(text_of(x), g.replace) for x in found]
        if g.connector == "%%":
            turns = max(len(out), len(found))
            out = [x for i in range(turns) for side in (out, found) for x in side[i : i + 1]]
        else:
            out += found
    return out


def first_text(rule: str | None, doc: Document, scope: Any = None) -> str | None:
    return next((t for t in (text_of(x) for x in run(rule, doc, scope)) if t), None)


def resolve(candidate: str | None, base: str | None, source: str | None = None) -> str | None:
    """An absolute http url of a candidate, or None."""
    c = (candidate or "").strip()
    if not c:
        return None
    if re.match(r"(?i)https?://", c):
        return c
    if c.startswith("//"):
        return "https:" + c
    for b in (base, source):
        if b and re.match(r"(?i)https?://", b):
            return urljoin(b, c)
    return "https://" + c if DOMAIN.fullmatch(c) else None
