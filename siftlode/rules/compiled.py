"""JSON rules as columns: what a constant rule selects in a JSON text, without leaving the JVM.

A rule compiles where its steps are names, indexes, slices and wildcards, in any groups of && || %%, with ##
replacements that Java and the web platform read alike.  Filters, `..` and everything that needs a document tree
do not; rules.frames runs those in Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftlode.functions.text import regex_replace, web_regex
from siftlode.rules.engine import Group, read_rule
from siftlode.rules.select import BadRule, json_steps


@lru_cache(4096)
def steps_of(rule: str) -> tuple[tuple[Group, tuple], ...] | None:
    """(group, JSON steps of its first step) for each group; None where the rule does not compile."""
    try:
        groups = read_rule(rule)
        out = []
        for g in groups:
            if len(g.steps) != 1 or g.steps[0].kind != "json" or not all(web_regex(p) and not (first and re.search(r"\\[1-9]", p)) for p, _, first in g.replace):
                return None
            path = tuple(json_steps(g.steps[0].value))
            if any(kind not in ("name", "index", "slice", "all") or (kind == "name" and ("'" in x or "\\" in x)) for kind, x in path):
                return None
            out.append((g, path))
    except BadRule:
        return None
    return tuple(out) or None


def number_text(v: Column, kind: Column) -> Column:
    """A number of a variant as the web platform writes it."""
    whole = (kind == "BIGINT") | kind.rlike(r"^DECIMAL\(\d+,0\)\z")
    d = F.try_variant_get(v, "$", "double")
    size = F.abs(d)
    cut = lambda c: F.regexp_replace(F.regexp_replace(c, r"(\.\d*?)0+\z", "$1"), r"\.\z", "")
    tiny = F.regexp_replace(F.regexp_replace(d.cast("string"), r"\.0E", "E"), "E(?=[0-9])", "E+")
    text = (
        F.when((d == F.rint(d)) & (size < 1e21), d.cast("decimal(38,0)").cast("string")).when((size >= 1) & (size < 1e17), cut(d.cast("decimal(38,20)").cast("string")))
        .when((size >= 1e-6) & (size < 1), cut(d.cast("decimal(38,24)").cast("string"))).otherwise(F.lower(tiny))
    )
    return F.when(whole, v.cast("string")).otherwise(text)


def _value(text: Column, v: Column, at: Column) -> Column:
    """struct(kind, text) of the value v of a JSON text, which stands at the concrete path `at`."""
    return F.get(F.transform(F.array(F.schema_of_variant(v)), lambda kind: _named(text, v, at, kind)), F.lit(0))


def _named(text: Column, v: Column, at: Column, kind: Column) -> Column:
    nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    number = ~nested & ~kind.isin("STRING", "BOOLEAN", "VOID")
    # a variant sorts the keys of its objects; the text itself has them as they were written
    said = F.when(nested, F.call_function("get_json_object", text, at)).when(kind == "VOID", "").when(number, number_text(v, kind)).otherwise(v.cast("string"))
    return F.struct(F.when(nested, "object").when(number, "number").otherwise("string").alias("kind"), said.alias("text"))


def _selected(text: Column, whole: Column, path: tuple) -> Column:
    """array<struct<kind,text>> of the values at a path; whole: the text as a variant."""
    head = []
    for kind, x in path:
        if kind == "name" or (kind == "index" and x >= 0):
            head.append(f"['{x}']" if kind == "name" else f"[{x}]")
        else:
            break
    start = "$" + "".join(head)
    v = F.try_variant_get(whole, start, "variant")
    found = F.filter(F.array(v), lambda x: x.isNotNull())  # parsed once; what follows names it
    if len(head) == len(path):
        return F.transform(found, lambda x: _value(text, x, F.lit(start)))
    node = lambda v, at: F.struct(v.alias("v"), at.alias("at"))
    state = F.transform(found, lambda x: node(x, F.lit(start)))
    for kind, x in path[len(head) :]:
        state = F.flatten(F.transform(state, _stepper(text, kind, x, node)))
    return F.transform(state, lambda n: _value(text, n["v"], n["at"]))


def _named_once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), where c is worked out once however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _stepper(text: Column, kind: str, x, node) -> Callable[[Column], Column]:
    return lambda n: _step(text, n, kind, x, node)


def _step(text: Column, n: Column, kind: str, x, node) -> Column:
    none = F.array().cast("array<struct<v:variant,at:string>>")
    if kind == "name":
        found = F.try_variant_get(n["v"], f"$['{x}']", "variant")
        return F.transform(F.filter(F.array(found), lambda v: v.isNotNull()), lambda v: node(v, F.concat(n["at"], F.lit(f"['{x}']"))))
    if kind == "all":
        return _named_once(F.try_variant_get(n["v"], "$", "array<variant>"), lambda items: _all(text, n, items, node))
    return _named_once(F.try_variant_get(n["v"], "$", "array<variant>"), lambda items: F.when(items.isNotNull(), _range(n, items, kind, x, node)).otherwise(none))


def _range(n: Column, items: Column, kind: str, x, node) -> Column:
    """The entry at an index, or those of a slice."""
    size = F.size(items)
    place = lambda b: F.lit(b) if b >= 0 else F.greatest(size + b, F.lit(0))
    if kind == "index":
        at = F.lit(x) if x >= 0 else size + x
        lo, count = F.greatest(at, F.lit(0)), F.when(at >= 0, 1).otherwise(0)
    else:
        lo = F.lit(0) if x[0] is None else place(x[0])
        count = F.greatest((size if x[1] is None else place(x[1])) - lo, F.lit(0))
    return F.transform(F.slice(items, lo + 1, count), lambda v, i: node(v, F.concat(n["at"], F.lit("["), (lo + i).cast("string"), F.lit("]"))))


def _all(text: Column, n: Column, items: Column, node) -> Column:
    none = F.array().cast("array<struct<v:variant,at:string>>")
    each = F.transform(items, lambda v, i: node(v, F.concat(n["at"], F.lit("["), i.cast("string"), F.lit("]"))))
    # all: entries of a list, or of an object in the order of its text
    entries = F.try_variant_get(n["v"], "$", "map<string,variant>")
    keys = F.map_keys(F.from_json(F.call_function("get_json_object", text, n["at"]), "map<string,string>"))
    of = F.transform(keys, lambda k: node(F.element_at(entries, k), F.concat(n["at"], F.lit("['"), k, F.lit("']"))))
    return F.when(items.isNotNull(), each).when(entries.isNotNull(), of).otherwise(none)


def _replacer(pattern: str, to: str, first: bool) -> Callable[[Column], Column]:
    return lambda x: F.struct(F.lit("string").alias("kind"), regex_replace(x["text"], pattern, to, first).alias("text"))


def compiled(rule: str, text: Column) -> Column | None:
    """array<struct<kind, text>> of what a constant rule selects in a JSON text; None if the rule does not compile.

    A null text, or one that is not JSON, gives an empty array."""
    groups = steps_of(rule)
    if groups is None:
        return None
    one = "array<struct<kind:string,text:string>>"
    return F.coalesce(_named_once(F.try_parse_json(text), lambda whole: _joined(groups, text, whole)), F.array()).cast(one)


def _joined(groups: tuple[tuple[Group, tuple], ...], text: Column, whole: Column) -> Column:
    out = None
    for g, path in groups:
        found = _selected(text, whole, path)
        for pattern, to, first in g.replace:
            found = F.transform(found, _replacer(pattern, to, first))
        if out is None:
            out = found
        elif g.connector == "||":
            out = F.when(F.size(out) > 0, out).otherwise(found)
        elif g.connector == "%%":
            out = F.filter(F.flatten(F.zip_with(out, found, lambda a, b: F.array(a, b))), lambda x: x.isNotNull())
        else:
            out = F.concat(out, found)
    return out
