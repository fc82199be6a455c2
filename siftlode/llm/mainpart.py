"""Main text of web pages by tag-path ratios.

Text nodes of a page are grouped by their root-to-leaf tag path.  A path whose nodes carry much text and much
punctuation each is where prose stands; a path of many short nodes without punctuation is a menu.  The ratios of
the paths are given to their nodes, smoothed along the page, fused, and thresholded; the chosen nodes tell which
region of the page is its article, and the article is all of that region but for what is marked as something else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import exp, log1p, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlode.rules.dom import Node, parse

#: Pages of one batch of results at most, and characters of html after which a batch ends.
ROWS, BATCH_CHARS = 500, 8 << 20
#: Nodes to each side that the smoothing sees.
REACH = 2
KERNEL = [exp(-(d * d) / 2) for d in range(-REACH, REACH + 1)]
#: A node is content if its smoothed fused ratio is at most so many standard deviations below the mean of the
#: page's characters.
LAMBDA = 1.0
#: A container is gone into as long as it holds this share of the content.
SHARE = 0.7

# Elements by what they are.
NEVER = frozenset("script style noscript template title meta link base svg math iframe object embed canvas audio video map select option textarea button input form fieldset dialog datalist".split())
ASIDE = frozenset("nav aside footer menu search".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
SECTIONS = frozenset("html body div main article section center table tbody tr td #document".split())
HEADS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar tablist".split())
#: Words of class names and ids that mark what is not the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adsbygoogle adbox adslot banner breadcrumb breadcrumbs comment comments commentlist disqus cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "footer header masthead menu nav navbar navigation pager pagination paywall promo promoted promotion recommended related respond reply replies share sharing sharebar sidebar sidebars signup skip social sponsor sponsored sponsors "
    "subscribe subscription newsletter toolbar topbar widget widgets login outbrain taboola".split()
)
#: Marks that, within a main part, are its own; and those that a heading or paragraph may bear.
OWN_MARKS = frozenset("header masthead banner".split())
COMMENTS = re.compile(r"\W*\d*\s*(comments?|responses?|replies|reader comments|leave a (reply|comment)|kommentare?|commentaires?|comentarios?)\W*\d*\W*", re.I)
#: Marks of articles that are not the page's own.
OTHER_ARTICLES = frozenset("ad advert advertisement comment comments promo promoted related reply sponsored".split())
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
#: Sentence marks of many scripts.
PUNCTUATION = re.compile("[.,;:!?…。，、；：！？।؟،]")


def _named(node: Node) -> set[str]:
    names = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}"
    return set(_WORDS.findall(_CAMEL.sub(" ", names).lower())) if len(names) > 1 else set()


def is_article(node: Node) -> bool:
    """Whether the page itself says that this is its main part."""
    return node.tag in ("article", "main") or node.attrs.get("role", "").lower() in ("main", "article") or node.attrs.get("itemprop", "").lower() == "articlebody"


def is_other(node: Node, inside: bool = False) -> bool:
    """Whether an element is marked as something else than the article.  inside: it stands in a main part,
    where a header is the article's own unless a name says otherwise."""
    if node.tag in NEVER or node.tag in ASIDE or (node.tag == "header" and not inside):
        return True
    a = node.attrs
    if not a:
        return False
    if a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return True
    if node.tag in ("html", "body"):
        return False  # their names tell of the whole page
    found = _named(node) & MARKS
    if is_article(node):
        return node.tag == "article" and bool(found & OTHER_ARTICLES)
    return bool(found - OWN_MARKS if inside or node.tag in HEADS or node.tag not in SECTIONS else found)


class Block:
    """Text of one block of the page: parts as they stand, its path, its ancestors' ids, and how much of it is links."""

    __slots__ = ("parts", "path", "at", "links", "text", "score")

    def __init__(self, path: int, at: Node):
        self.parts: list[str] = []
        self.path, self.at, self.links, self.text, self.score = path, at, 0, "", 0.0


def blocks_of(root: Node, marks: bool = True) -> list[Block]:
    """The blocks with text, in page order, without what is marked as something else (marks: by names too).

    Inline elements belong to the block around them; a block that stands in the middle of another cuts it.
    No recursion: a page may be nested as deeply as it likes."""
    out: list[Block] = []
    paths: dict[tuple[int, str], int] = {}
    now = Block(0, root)
    out.append(now)
    # (node or text, path, nearest block element, in a link, in a main part); None: the block around goes on anew
    stack: list[tuple] = [(root, 0, root, False, False)]
    while stack:
        x, path, at, link, inside = stack.pop()
        if isinstance(x, str):
            now.parts.append(x)
            if link:
                now.links += len(x.strip())
            continue
        if x is None:
            now = Block(path, at)
            out.append(now)
            continue
        if x.tag == "br":
            now.parts.append("\n")
            continue
        if x is not root and (is_other(x, inside) if marks else x.tag in NEVER):
            if x.tag in BLOCKS or x.tag == "form":
                now = Block(path, at)
                out.append(now)
            continue
        inside = inside or is_article(x)
        outer = path
        path = paths.setdefault((path, f"{x.tag} {x.attrs.get('class', '')}"), len(paths) + 1)
        if x.tag in BLOCKS:
            stack.append((None, outer, at, link, inside))
            now = Block(path, x)
            out.append(now)
            at = x
        link = link or x.tag == "a"
        for c in reversed(x.children):
            stack.append((c, path, at, link, inside))
    for b in out:
        b.text = " ".join("".join(b.parts).split())
    return [b for b in out if b.text]


def score(blocks: list[Block]) -> float:
    """Sets the score of each block; returns the threshold.

    Of a path: text ratio, its characters outside links by its nodes, and punctuation ratio, its sentence marks
    by its nodes.  A node's fused ratio is the logarithm of both ratios' geometric mean, so that one very long
    path does not hide the others; it is smoothed over the neighbours by a Gaussian window.  Mean and deviation
    count characters, not nodes: a page may have many more menu lines than paragraphs."""
    paths: dict[int, list[float]] = {}
    for b in blocks:
        p = paths.setdefault(b.path, [0.0, 0.0, 0.0])
        p[0] += max(0, len(b.text) - b.links)
        p[1] += len(PUNCTUATION.findall(b.text)) if b.links * 2 < len(b.text) else 0
        p[2] += 1
    fused = [log1p(sqrt(p[0] / p[2] * (1 + p[1] / p[2]))) for p in (paths[b.path] for b in blocks)]
    n = len(blocks)
    for i, b in enumerate(blocks):
        lo, hi = max(0, i - REACH), min(n, i + REACH + 1)
        near = KERNEL[lo - i + REACH : hi - i + REACH]
        # a node without text of its own does not become content by its neighbours
        b.score = sum(w * v for w, v in zip(near, fused[lo:hi], strict=True)) / sum(near) if fused[i] else 0.0
    size = sum(len(b.text) for b in blocks)
    mean = sum(b.score * len(b.text) for b in blocks) / size
    return mean - LAMBDA * sqrt(sum((b.score - mean) ** 2 * len(b.text) for b in blocks) / size)


def _chain(node: Node) -> list[Node]:
    out = [node]
    while out[-1].parent is not None:
        out.append(out[-1].parent)
    return out[::-1]


def region(blocks: list[Block], threshold: float) -> Node | None:
    """The element that is the article: from the root down, while one container has most of the content.

    It stops at what the page itself calls its article, and above a heading that would be left out."""
    weight: dict[int, float] = {}
    children: dict[int, dict[int, Node]] = {}
    heads: dict[int, set[int]] = {}  # of a container: the children under which a heading stands before its content
    top = None
    for b in blocks:
        w = b.score * len(b.text) if b.score >= threshold and b.score > 0 else 0.0
        chain = _chain(b.at)
        top = top or chain[0]
        for up, down in zip(chain, chain[1:], strict=False):
            weight[id(down)] = weight.get(id(down), 0.0) + w
            children.setdefault(id(up), {})[id(down)] = down
            if b.at.tag in ("h1", "h2") or any(c.tag in ("h1", "h2") for c in chain[-3:]):
                heads.setdefault(id(up), set()).add(id(down))
        weight[id(chain[0])] = weight.get(id(chain[0]), 0.0) + w
    at = top
    while at is not None and not (is_article(at) and at.tag != "main"):
        total = weight.get(id(at), 0.0)
        down = max(children.get(id(at), {}).values(), key=lambda c: weight[id(c)], default=None)
        named = [c for c in children.get(id(at), {}).values() if is_article(c) and weight[id(c)] > 0]
        if named:
            down = max(named, key=lambda c: weight[id(c)])
            if sum(weight[id(c)] for c in named) > weight[id(down)] / SHARE:
                break  # several articles: all of them
        elif down is None or down.tag not in SECTIONS or not total or weight[id(down)] < SHARE * total:
            break
        elif at.tag not in ("html", "body", "#document") and heads.get(id(at), set()) - {id(down)}:
            break
        at = down
    return at


def main_text(html: str | None) -> str:
    """The article of a page: its blocks, each with single spaces, joined by one space.

    In the article's region, a part without any content of its own, such as a list of links, goes; headings,
    short paragraphs, lists, tables and captions of the region stay whole."""
    if not html or html.isspace():
        return ""
    try:
        root = parse(html)
    except AssertionError:  # what the tokenizer makes of a marked section that it does not know
        root = parse(html.replace("<![", "&lt;!["))
    blocks = blocks_of(root)
    if not blocks and any(is_article(n) for n in root.walk()):
        # the article stands in a menu or the like that was never closed
        blocks = [b for b in blocks_of(root, marks=False) if any(is_article(n) for n in _chain(b.at))]
    gone = {id(b.at.parent) for b in blocks if b.at.tag in ("h2", "h3", "h4", "h5", "h6") and COMMENTS.fullmatch(b.text) and b.at.parent.tag in ("div", "section") and not is_article(b.at.parent)}
    if gone:
        blocks = [b for b in blocks if not any(id(n) in gone for n in _chain(b.at))]
    if not blocks:
        return ""
    threshold = score(blocks)
    top = region(blocks, threshold)
    depth = len(_chain(top))
    inside, held = [], {}
    for b in blocks:
        chain = _chain(b.at)
        if len(chain) < depth or chain[depth - 1] is not top:
            continue
        part = chain[depth] if len(chain) > depth else b.at
        inside.append((b, part))
        got = held.setdefault(id(part), [0, 0, False])
        got[0] += len(b.text)
        got[1] += b.links
        got[2] |= b.score >= threshold and b.score > 0
    kept = []
    for b, part in inside:
        size, links, content = held[id(part)]
        if part.tag in SECTIONS | {"ul", "ol", "dl"} and part is not top and size < 2 * links:
            continue  # a list of links
        if part.tag in SECTIONS and part is not top and not is_article(top) and not content:
            continue  # a part of the page without prose
        kept.append(b.text)
    return " ".join(kept)


def extract(pages: DataFrame, html: str = "html", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """pages -> keys, text, n_chars (long): the main text of every row, worked out where the row is read.

    A null, blank or unreadable html has the empty text; rows with null or repeated keys are told like others;
    other columns, whatever their names, are ignored; an empty table gives no rows.  A page is held once as
    text and once as a tree, some 20 times its size at most, and nothing of it is cut off."""
    kept = pages.select(*keys, F.col(html).alias("__html"))
    schema = ", ".join(f"`{k}` {kept.schema[k].dataType.simpleString()}" for k in keys) + ", text string, n_chars bigint"

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(b, lo, texts):
            return pa.RecordBatch.from_arrays([*(b[j].slice(lo, len(texts)) for j in range(len(keys))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keys, "text", "n_chars"])

        for b in batches:
            lo, texts, held = 0, [], 0
            for x in b[len(keys)]:
                page = x.as_py()
                texts.append(main_text(page))
                held += len(page or "")
                if len(texts) >= ROWS or held >= BATCH_CHARS:
                    yield packed(b, lo, texts)
                    lo, texts, held = lo + len(texts), [], 0
            if texts:
                yield packed(b, lo, texts)

    return kept.mapInArrow(go, schema)
