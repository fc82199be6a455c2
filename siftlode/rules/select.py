"""CSS, XPath and JSONPath selection."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache
from typing import Any

from siftlode.rules.dom import Node

_PART = re.compile(r"""(?P<tag>[a-zA-Z][\w-]*|\*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<attr>[\w:-]+)(?:(?P<op>[~^$*|]?=)(?P<val>"[^"]*"|'[^']*'|[^\]]*))?\]|:(?P<pseudo>[\w-]+)(?:\((?P<arg>(?:[^()]|\([^()]*\))*)\))?""")


class BadRule(ValueError):
    """A rule that this engine cannot read."""


def _siblings(n: Node) -> list[Node]:
    return n.parent.elements() if n.parent else [n]


def _nth(arg: str, at: int) -> bool:
    arg = {"odd": "2n+1", "even": "2n"}.get(arg.strip(), arg.replace(" ", ""))
    m = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", arg)
    if not m or not arg:
        raise BadRule(f":nth-child({arg})")
    b = int(m[2] or 0)
    if m[1] is None:
        return at == b
    a = int(m[1] + "1") if m[1] in ("", "+", "-") else int(m[1])
    return at == b if a == 0 else (at - b) % a == 0 and (at - b) // a >= 0


_OPS: dict[str, Callable[[str, str], bool]] = {
    "=": lambda a, v: a == v, "~=": lambda a, v: v in a.split(), "^=": lambda a, v: bool(v) and a.startswith(v),
    "$=": lambda a, v: bool(v) and a.endswith(v), "*=": lambda a, v: bool(v) and v in a, "|=": lambda a, v: a == v or a.startswith(v + "-"),
}


def _compound(text: str) -> list[Callable[[Node], bool]]:
    tests: list[Callable[[Node], bool]] = []
    at = 0
    while at < len(text):
        m = _PART.match(text, at)
        if not m or m.end() == at:
            raise BadRule(f"selector: {text}")
        at = m.end()
        if m["tag"]:
            if m["tag"] != "*":
                tests.append(lambda n, t=m["tag"].lower(): n.tag == t)
        elif m["id"]:
            tests.append(lambda n, v=m["id"]: n.attrs.get("id") == v)
        elif m["cls"]:
            tests.append(lambda n, v=m["cls"]: v in n.attrs.get("class", "").split())
        elif m["attr"]:
            if m["op"]:
                tests.append(lambda n, k=m["attr"], f=_OPS[m["op"]], v=m["val"].strip("\"'"): k in n.attrs and f(n.attrs[k], v))
            else:
                tests.append(lambda n, k=m["attr"]: k in n.attrs)
        else:
            name, arg = m["pseudo"], m["arg"] or ""
            if name == "contains":
                tests.append(lambda n, v=arg.strip("\"'"): v in n.text())
            elif name == "first-child":
                tests.append(lambda n: _siblings(n)[0] is n)
            elif name == "last-child":
                tests.append(lambda n: _siblings(n)[-1] is n)
            elif name == "nth-child":
                _nth(arg, 1)
                tests.append(lambda n, v=arg: _nth(v, next(i for i, s in enumerate(_siblings(n), 1) if s is n)))
            elif name == "not":
                inner = _compound(arg.strip())
                tests.append(lambda n, inner=inner: not all(t(n) for t in inner))
            else:
                raise BadRule(f":{name}")
    if not text:
        raise BadRule("empty selector")
    return tests


def _outside(text: str, marks: str) -> list[tuple[str, str]]:
    """text cut at marks outside brackets and quotes: (mark before, part)."""
    out, depth, quote, part, mark = [], 0, "", "", ""
    for ch in text:
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "\"'":
            quote = ch
        elif ch in "[(":
            depth += 1
        elif ch in "])":
            depth -= 1
        elif not depth and ch in marks:
            out.append((mark, part))
            mark, part = ch, ""
            continue
        part += ch
    return [*out, (mark, part)]


@lru_cache(4096)
def _css(selector: str) -> list[list[tuple[str, list]]]:
    """Alternatives, each a list of (combinator before, tests) from left to right."""
    found = []
    for _, one in _outside(selector, ","):
        steps, how = [], " "
        for mark, part in _outside(one.strip(), " >+~\t\n"):
            if mark in (">", "+", "~"):
                how = mark
            if part:
                steps.append((how, _compound(part)))
                how = " "
        if not steps:
            raise BadRule(f"selector: {selector}")
        found.append(steps)
    return found


def _matches(n: Node, steps: list, top: Node) -> bool:
    how, tests = steps[-1]
    if n.tag == "#document" or not all(t(n) for t in tests):
        return False
    if len(steps) == 1:
        return True
    rest = steps[:-1]
    if how == ">":
        return n.parent is not None and _matches(n.parent, rest, top)
    if how in "+~":
        before = _siblings(n)
        before = before[: next(i for i, s in enumerate(before) if s is n)]
        return any(_matches(s, rest, top) for s in (before[-1:] if how == "+" else before))
    p = n.parent
    while p is not None:
        if _matches(p, rest, top):
            return True
        p = p.parent
    return False


def css(root: Node, selector: str) -> list[Node]:
    """Descendants of root that match, in document order."""
    wanted = _css(selector.strip())
    return [n for n in root.walk() if any(_matches(n, steps, root) for steps in wanted)]


def css_is(n: Node, selector: str) -> bool:
    return any(_matches(n, steps, n) for steps in _css(selector.strip()))


_STEP = re.compile(r"(//?)(@[\w:-]+|text\(\)|\*|\.\.?|[\w:-]+)((?:\[[^\]]*\])*)")


def xpath(root: Node, path: str) -> list[Node | str]:
    at: list[Node | str] = [root]
    path = path if path.startswith("/") else "//" + path
    end = 0
    for m in _STEP.finditer(path):
        if m.start() != end:
            raise BadRule(f"xpath: {path}")
        end = m.end()
        deep, name, tests = m[1] == "//", m[2], re.findall(r"\[([^\]]*)\]", m[3])
        found: list[Node | str] = []
        for n in at:
            if not isinstance(n, Node):
                continue
            pool = [n, *n.walk()] if deep else [n]
            if name.startswith("@"):
                found += [p.attrs[name[1:]] for p in pool if name[1:] in p.attrs]
            elif name == "text()":
                found += [c for p in pool for c in p.children if isinstance(c, str)]
            else:
                for p in pool:
                    hits = [c for c in p.elements() if name in ("*", c.tag)] if name not in (".", "..") else [p] if name == "." else [p.parent] if p.parent else []
                    for t in tests:
                        hits = _keep(hits, t)
                    found += hits
        seen: set[int] = set()
        at = [x for x in found if isinstance(x, str) or not (id(x) in seen or seen.add(id(x)))]
    if end != len(path):
        raise BadRule(f"xpath: {path}")
    return at


def _keep(hits: list[Node], test: str) -> list[Node]:
    test = test.strip()
    if re.fullmatch(r"\d+", test):
        return hits[int(test) - 1 : int(test)]
    if test == "last()":
        return hits[-1:]
    if m := re.fullmatch(r"@([\w:-]+)(?:\s*=\s*(['\"])(.*)\2)?", test):
        return [n for n in hits if m[1] in n.attrs and (m[2] is None or n.attrs[m[1]] == m[3])]
    if m := re.fullmatch(r"contains\(\s*(@[\w:-]+|text\(\))\s*,\s*(['\"])(.*)\2\s*\)", test):
        return [n for n in hits if m[3] in (n.own_text() if m[1] == "text()" else n.attrs.get(m[1][1:], ""))]
    raise BadRule(f"xpath predicate: {test}")


_TOKEN = re.compile(r"""\.\.(?P<deep>[\w\u0080-￿-]+|\*)|\.(?P<name>[\w\u0080-￿-]+|\*)|\[(?:(?P<all>\*)|(?P<q>['"])(?P<key>.*?)(?P=q)|(?P<slice>-?\d*:-?\d*)|(?P<i>-?\d+)|\?\((?P<test>.*?)\))\]""")
_TEST = re.compile(r"""@\.([\w.]+)\s*(?:(==|!=|<=|>=|<|>)\s*(.+))?""")


def _values(x: Any) -> list:
    return list(x.values()) if isinstance(x, dict) else list(x) if isinstance(x, list) else []


def _deep(x: Any) -> list:
    out, stack = [], [x]
    while stack:
        v = stack.pop()
        out.append(v)
        stack.extend(_values(v)[::-1])
    return out


def _passes(x: Any, test: str) -> bool:
    m = _TEST.fullmatch(test.strip())
    if not m:
        raise BadRule(f"jsonpath filter: {test}")
    for part in m[1].split("."):
        if not isinstance(x, dict) or part not in x:
            return False
        x = x[part]
    if not m[2]:
        return bool(x)
    try:
        y = json.loads(m[3].strip().replace("'", '"'))
        return {"==": x == y, "!=": x != y}[m[2]] if m[2] in ("==", "!=") else {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[m[2]]
    except (ValueError, TypeError):
        return False


@lru_cache(4096)
def json_steps(path: str) -> tuple[tuple[str, Any], ...]:
    """(kind, value) of the steps of a path: name, index, slice (from, to), all, test; deep for ..name, deepall for ..*"""
    out, end = [], 1
    if not path.startswith("$"):
        raise BadRule(f"jsonpath: {path}")
    for m in _TOKEN.finditer(path, 1):
        if m.start() != end:
            break
        end = m.end()
        if m["deep"]:
            out.append(("deepall", None) if m["deep"] == "*" else ("deep", m["deep"]))
        elif m["all"] or m["name"] == "*":
            out.append(("all", None))
        elif m["name"] or m["q"]:
            out.append(("name", m["name"] or m["key"]))
        elif m["slice"]:
            out.append(("slice", tuple(int(s) if s else None for s in m["slice"].split(":"))))
        elif m["i"]:
            out.append(("index", int(m["i"])))
        else:
            out.append(("test", m["test"]))
    if end != len(path):
        raise BadRule(f"jsonpath: {path}")
    return tuple(out)


def jsonpath(data: Any, path: str) -> list:
    at = [data]
    for kind, x in json_steps(path):
        if kind in ("deep", "deepall"):
            pool = [v for y in at for v in _deep(y)]
            at = [z for y in pool for z in _values(y)] if kind == "deepall" else [y[x] for y in pool if isinstance(y, dict) and x in y]
        elif kind == "all":
            at = [z for y in at for z in _values(y)]
        elif kind == "name":
            at = [y[x] for y in at if isinstance(y, dict) and x in y]
        elif kind == "slice":
            at = [z for y in at if isinstance(y, list) for z in y[x[0] : x[1]]]
        elif kind == "index":
            at = [y[x] for y in at if isinstance(y, list) and -len(y) <= x < len(y)]
        else:
            at = [z for y in at for z in _values(y) if _passes(z, x)]
    return at
