"""A tolerant HTML tree on the standard library's tokenizer."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape
from html.entities import html5
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element of the key is closed when one of the values opens.
IMPLIED = {
    "p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
}
#: A script or style, which has no references; or an ampersand, and the name or number that a semicolon ends, if any.
REFERENCE = re.compile(r"<(script|style)\b.*?</\1\s*>|&(?:([A-Za-z][A-Za-z0-9]*;)|(#\d+;|#x[0-9A-F]+;))?", re.I | re.S)
FENCES = frozenset("table ul ol dl select".split())


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.parent = tag, attrs or {}, parent
        self.children: list[Node | str] = []

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self) -> Iterator[Node]:
        """Descendant elements in document order, without recursion."""
        stack = self.elements()[::-1]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(n.elements()[::-1])

    def text(self) -> str:
        out, stack = [], list(self.children[::-1])
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                out.append(c)
            elif c.tag not in ("script", "style"):
                stack.extend(c.children[::-1])
        return "".join(out)

    def own_text(self) -> str:
        return "".join(c for c in self.children if isinstance(c, str))

    def html(self, outer: bool = True) -> str:
        inner = "".join(escape(c, quote=False) if isinstance(c, str) and self.tag not in ("script", "style") else c if isinstance(c, str) else c.html() for c in self.children)
        if not outer or self.tag == "#document":
            return inner
        attrs = "".join(f' {k}="{escape(v)}"' for k, v in self.attrs.items())
        return f"<{self.tag}{attrs}>" + ("" if self.tag in VOID else f"{inner}</{self.tag}>")


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#document")

    def handle_starttag(self, tag, attrs):
        n = self.at
        while n.parent is not None:
            if tag in IMPLIED.get(n.tag, ()):
                self.at = n.parent
                break
            if n.tag in FENCES:
                break
            n = n.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def _closed(m: re.Match) -> str:
    return m[0] if m[1] or m[3] or m[2] in html5 else f"&amp;{m[0][1:]}"


def parse(html: str | None, open_references: bool = True) -> Node:
    """The tree of a page.  Browsers also read old references that no semicolon ends (`&amp`); without
    open_references these stay as they are written, as in XML."""
    b = _Builder()
    b.feed((html or "") if open_references else REFERENCE.sub(_closed, html or ""))
    b.close()
    return b.root
