"""Rules over DataFrames: each document is parsed once in its task and all its rules run on it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlode.rules.compiled import compiled
from siftlode.rules.engine import Document, first_text, kind_of, resolve, run, text_of
from siftlode.rules.select import BadRule

#: Documents of one batch at most, so that bodies of 256 KB stay within a worker's memory.
ROWS = 500


def apply_rule(df: DataFrame, rule: str, content: str = "html", keys: tuple[str, ...] = ("page_id",), open_references: bool = True) -> DataFrame:
    """One row for each value of a rule: keys, ord, kind, text.  An unreadable rule yields no rows.
    Without open_references, character references of a page that no semicolon ends stay as they are.

    A rule on JSON that compiles runs as columns; the others run in Python, each document parsed once."""
    if (values := compiled(rule, F.col(content))) is not None:
        rows = df.select(*keys, F.posexplode(values).alias("ord", "__v"))
        return rows.select(*keys, "ord", F.col("__v.kind").alias("kind"), F.col("__v.text").alias("text"))
    kept = df.select(*keys, F.col(content).alias("__content"))
    schema = ", ".join(f"`{k}` {kept.schema[k].dataType.simpleString()}" for k in keys) + ", ord int, kind string, text string"

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                b = whole.slice(lo, ROWS)
                at, ord_, kind, text = [], [], [], []
                for i, body in enumerate(b[len(keys)].to_pylist()):
                    try:
                        found = run(rule, Document(body, open_references))
                    except BadRule:
                        found = []
                    for n, x in enumerate(found):
                        at.append(i)
                        ord_.append(n)
                        kind.append(kind_of(x))
                        text.append(text_of(x))
                cols = [b[j].take(pa.array(at, pa.int64())) for j in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(ord_, pa.int32()), pa.array(kind, pa.string()), pa.array(text, pa.string())], [*keys, "ord", "kind", "text"])

    return kept.mapInArrow(go, schema)


def items_of(body: str | None, list_rule: str | None, base: str | None, rules: list[str | None], names: list[str], urls: tuple[str, ...]) -> tuple[list[tuple], str | None]:
    """(values of each item, preview, error) for the items of a document; and what is wrong with its list rule."""
    doc = Document(body)
    unread = lambda bad: str(bad) if str(bad).startswith("unsupported") else "unsupported_rule_syntax"
    try:
        found = run(list_rule, doc) if list_rule else [None]
    except BadRule as bad:
        return [], unread(bad)
    rows = []
    for item in found:
        values, error = [], None
        for name, rule in zip(names, rules, strict=True):
            try:
                v = first_text(rule, doc, item)
            except BadRule as bad:
                v, error = None, unread(bad)
            values.append(resolve(v, base) if name in urls else v)
        rows.append((values, text_of(item if item is not None else doc.body)[:80], error))
    return rows, None


def extract_items(df: DataFrame, list_rule: Column, fields: dict[str, Column], content: str = "body", base: Column | None = None, urls: tuple[str, ...] = (), keys: tuple[str, ...] = ("idx",)) -> DataFrame:
    """One row for each item of list_rule (or the whole document where it is empty): keys, ord, the fields
    as text, confidence (share of rules that gave a value), preview, error.  Fields named in urls are
    resolved against base.  A document without items gives one row with a null ord."""
    names = list(fields)
    kept = df.select(*keys, F.col(content).alias("__content"), list_rule.alias("__list"), (base if base is not None else F.lit(None).cast("string")).alias("__base"), *[c.alias(f"__f_{n}") for n, c in fields.items()])
    schema = ", ".join(f"`{k}` {kept.schema[k].dataType.simpleString()}" for k in keys) + ", ord int, " + ", ".join(f"`{n}` string" for n in names) + ", confidence double, preview string, error string"
    out_names = [*keys, "ord", *names, "confidence", "preview", "error"]
    types = [pa.int32(), *[pa.string()] * len(names), pa.float64(), pa.string(), pa.string()]

    def items(body, list_rule_, base_, rules):
        found, unread = items_of(body, list_rule_, base_, rules, names, urls)
        asked = sum(bool(r) for r in rules)
        rows = [(n, *values, sum(v is not None for v, r in zip(values, rules, strict=True) if r) / asked if asked else 0.0, preview, error) for n, (values, preview, error) in enumerate(found)]
        return rows or [(None, *[None] * len(names), 0.0, None, unread)]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(keys)
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                b = whole.slice(lo, ROWS)
                at, rows = [], []
                cols = [b[j].to_pylist() for j in range(k, len(b.schema.names))]
                for i, (body, rule, base_, *rules) in enumerate(zip(*cols, strict=True)):
                    found = items(body, rule, base_, rules)
                    rows += found
                    at += [i] * len(found)
                data = list(zip(*rows, strict=True)) or [[]] * len(types)
                yield pa.RecordBatch.from_arrays([*[b[j].take(pa.array(at, pa.int64())) for j in range(k)], *[pa.array(c, t) for c, t in zip(data, types, strict=True)]], out_names)

    return kept.mapInArrow(go, schema)


class Remembered:
    """A function of (body, list rule, url, rules) that is worked out once for rows which ask the same of the same page
    one after the other: a join by url leaves them side by side."""

    def __init__(self, work: Callable):
        self.work, self.at, self.known = work, (None, None), {}

    def __call__(self, body: str | None, list_rule: str | None, base: str | None, *rules: str | None):
        if body is None:
            return None
        if self.at != (base, body):
            self.at, self.known = (base, body), {}
        asked = (list_rule, *rules)
        if asked not in self.known:
            self.known[asked] = self.work(body, list_rule, base, *rules)
        return self.known[asked]


def extract_one(df: DataFrame, list_rule: Column, fields: dict[str, Column], content: str, base: Column, urls: tuple[str, ...] = ()) -> DataFrame:
    """df without content + got: n (items), error, first (fields of the first item), some (the first value of
    each field in any item), one row for each row; n is null where content is.

    What a record's next request needs of a page is settled in the task that parses it, so the items
    of a page are never rows; rows that ask the same of one page side by side share its parse.  A plain
    UDF takes a hundred rows at a time and nothing but its arguments, where an Arrow batch is thousands of
    whole rows: what a worker holds does not grow with the rows of its task."""
    names = list(fields)
    values = ", ".join(f"{n}: string" for n in names)

    def one(body, list_rule_, base_, *rules):
        found, unread = items_of(body, list_rule_, base_, list(rules), names, urls)
        some = tuple(next((v[i] for v, _, _ in found if v[i] is not None), None) for i in range(len(names)))
        return len(found), unread or next((e for _, _, e in found if e), None), tuple(found[0][0]) if found else (None,) * len(names), some

    told = Remembered(one)
    # not deterministic for the optimizer, which would else run it again for the columns that are made of it
    work = F.udf(lambda *x: told(*x), f"n int, error string, first struct<{values}>, some struct<{values}>", useArrow=False).asNondeterministic()
    return df.withColumn("got", work(F.col(content), list_rule, base, *fields.values())).drop(content)
