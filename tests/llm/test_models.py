"""Language profiles and the quality model: brute force, held-out accuracy and edge cases."""

import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from siftlode.llm import langid, quality

SF = "/root/testdata/sf0.01"


def plain_grams(text):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    out = Counter()
    for w in words:
        p = f" {w} "
        out.update(g for n in range(1, 5) for k in range(len(p) - n + 1) if (g := p[k : k + n]) != " ")
    return out


def name(code):
    return "".join(chr(c) for c in [(int(code) >> s) & 0xFFFF for s in (48, 32, 16, 0)] if c)


def test_grams_against_brute_force(monkeypatch):
    for text in ("The cat's ÉTÉ, naïve 12 x", "a", " -- ", None, "ab " * 50 + "ß"):
        codes, counts = langid.grams(text)
        assert {name(c): int(n) for c, n in zip(codes, counts, strict=True)} == plain_grams(text)
    text = "some words here and there " * 9
    whole = dict(zip(*map(list, langid.grams(text)), strict=True))
    monkeypatch.setattr(langid, "CHUNK", 11)
    assert dict(zip(*map(list, langid.grams(text)), strict=True)) == whole


def test_distance_is_out_of_place():
    rank = lambda t: [c for c in langid.most_frequent(*langid.grams(t), 20)]
    ranked = {"aa": rank("banana bandana"), "bb": rank("kiwi wiki")}
    p = langid.Profiles.of(ranked, 20)
    doc = rank("ban kiwi na")
    want = {lang: sum(abs(i - r.index(c)) if c in r else 20 for i, c in enumerate(doc)) for lang, r in ranked.items()}
    lang, score = p.judge("ban kiwi na")
    assert lang == min(want, key=lambda x: (want[x], x)) and abs(score - (1 - want[lang] / (20 * len(doc)))) < 1e-12
    assert p.judge(None) == p.judge("12 !") == ("und", 0.0) and langid.Profiles.of({}, 20).judge("abc") == ("und", 0.0)


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fold = langid.fold(F.col("doc_id"), 4)
    profiles = langid.learn(docs.where(fold != 2), docs_per_language=50)
    got = langid.identify(docs.where(fold == 2), profiles).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang == got.lang_pred).mean() >= 0.98 and got.score.between(0, 1).all()
    assert docs.select("doc_id", fold.alias("f")).first().f == zlib.crc32(str(docs.first().doc_id).encode()) % 4
    odd = spark.createDataFrame([(None, None, "q"), (1, "", "q"), (1, "99", "q"), (2, "the " * 60000, "q")], "doc_id long, text string, score string")
    assert sorted((r.lang_pred != "und") for r in langid.identify(odd, profiles).collect()) == [False, False, False, True]
    assert langid.identify(odd.where(F.lit(False)), profiles).collect() == []


def test_held_out_quality(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    fold = langid.fold(F.col("doc_id"), 5)
    model = quality.learn(docs, labels.where(fold != 0), max_rows=1500)
    rows = docs.join(labels.where(fold == 0), "doc_id")
    got = quality.score(rows, model, keep=("quality", "text")).toPandas()
    good, bad = got[got.quality == 1].score, got[got.quality == 0].score
    assert (good >= 0.3).mean() >= 0.99 and (bad < 0.3).mean() >= 0.9


def test_model_edges(spark):
    assert quality.features(None) == quality.features("") == [0.0] * len(quality.FEATURES)
    assert all(np.isfinite(quality.features(t)).all() for t in (" ", "\n", "a", "é" * 9, "x " * 99999))
    none = quality.fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0))
    assert none.score(np.zeros((2, len(quality.FEATURES)))).tolist() == [0.5, 0.5]
    x = np.random.default_rng(0).normal(size=(400, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)  # only the pair tells
    m = quality.fit(x, y)
    assert (0, 1) in m.pairs and ((m.score(x) > 0.5) == y).mean() > 0.9
    odd = spark.createDataFrame([(None, None, 1), (5, "text", 2), (5, "text", 2)], "doc_id long, text string, score int")
    got = quality.score(odd, none).toPandas()
    assert len(got) == 3 and isinstance(got, pd.DataFrame) and quality.score(odd.where(F.lit(False)), none).collect() == []
