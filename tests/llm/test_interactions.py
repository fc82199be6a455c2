"""The filter interaction audit against a walk through every order, document by document."""

import re
from itertools import permutations

import pytest

from siftlode.llm import interactions

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def walked(docs, labels, filters="ABCDE"):
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    told = {}
    for i, text, lang in docs:
        t = text or ""
        w = WORDS.findall(t)
        fails = {f for f, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), re.search(r"[#$%&*|]", t) is not None, i is not None and first[t] < i), strict=True) if bad}
        for order in permutations(filters):
            gone = False
            for k, f in enumerate(order, 1):
                row = told.setdefault((lang or "", "".join(order), k), dict.fromkeys(("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"), 0))
                here = f in fails and not gone
                row["redundant"] += f in fails and gone
                gone |= here
                row["removed"] += here
                row["kept"] += not gone
                row["unique_fails"] += fails & set(filters) == {f}
                row["good_lost"] += here and i in good
                row["toxic_lost"] += here and i in toxic
    for (part, order, k), row in told.items():
        row["shapley"] = sum(r["removed"] for (p, o, s), r in told.items() if p == part and o[s - 1] == order[k - 1])
    return told


long_ = " ".join(f"w{i}" for i in range(220))
DOCS = [
    (1, long_, "en"), (2, long_, "en"), (3, long_, None), (4, "", "de"), (5, None, "de"), (6, "a b a b a", "en"), (6, "a b a b a", "en"), (7, "SHOUT " * 250, None), (8, long_ + " # $", "en"), (9, "x y　z", ""),
    (None, long_, "en"), (None, None, None), (10, "Z" * 3 + "a" * 97, "de"), (11, "Z" * 4 + "é" * 96, "de"), (12, "wort\x0bnoch\x1ceins " * 5000, "de"), (13, long_ + " plain", "fr"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (6, None, 1), (8, 1, None), (None, 1, 1), (99, 1, 1), (13, 0, 1)]


def test_every_order_and_step_is_told_as_a_walk_tells_it(spark):
    docs = spark.createDataFrame([(*d, "x", True, 5) for d in DOCS], "doc_id long, text string, lang string, part string, A boolean, docs int")
    labels = spark.createDataFrame([(*x, "y") for x in LABELS], "doc_id long, quality int, toxic int, good string")
    got = {(r.part, r.filter_order, r.step): {c: r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")} for r in interactions.audit(interactions.marked(interactions.failures(docs), labels)).collect()}
    assert got == walked(DOCS, LABELS) and len(got) == 4 * 600


def test_other_filters_null_flags_and_parts(spark):
    rows = spark.createDataFrame([("p", True, None, 1, 0), ("p", False, True, 0, 1), (None, True, True, 1, 1), (None, None, None, 0, 0)], "part string, short boolean, dirty boolean, good int, toxic int")
    got = {(r.part, r.mask): (r.docs, r.good, r.toxic) for r in interactions.survivors(rows, ("short", "dirty")).collect()}
    assert got == {("p", 0): (2, 1, 1), ("p", 1): (1, 0, 1), ("p", 2): (1, 1, 0), ("p", 3): (0, 0, 0), (None, 0): (2, 1, 1), (None, 1): (1, 0, 0), (None, 2): (1, 0, 0), (None, 3): (1, 0, 0)}
    steps = interactions.audit(rows, ("short", "dirty")).collect()
    assert len(steps) == 8 and {r.shapley for r in steps if r.part is None} == {1} and all(r.kept_share == r.kept / 2 for r in steps)
    with pytest.raises(ValueError, match="1 to 6"):
        interactions.audit(rows, tuple("ABCDEFG"))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interactions.audit(interactions.marked(interactions.failures(docs), labels)).collect() == []
    one = spark.createDataFrame([(1, "few words", "en")], docs.schema)
    got = interactions.audit(interactions.marked(interactions.failures(one), labels)).collect()
    assert len(got) == 600 and {r.good_lost for r in got} == {0} and {r.removed for r in got if r.letter == "A"} == {1}
