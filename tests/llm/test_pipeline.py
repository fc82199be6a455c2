from collections import Counter

import corpus_pipeline as P
from siftlode.llm import packing, simhash, suffixes

SF = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, SF).cache()
        seen[name] = docs
        if name != "packing":
            assert docs.columns == list(P.COLUMNS)
    fps = {r.doc_id: simhash.fingerprint(r.text) for r in seen["simhash"].collect()}
    keys = list(fps.values())
    assert not any((a ^ b).bit_count() <= 3 for i, a in enumerate(keys) for b in keys[:i])
    assert not suffixes.repeated_spans(seen["suffixes"]).collect()
    mixed = seen["mixing"].collect()
    assert max(Counter(r.doc_id for r in mixed).values()) <= 3
    packed = docs.collect()
    size = Counter()
    for r in packed:
        size[r.bin_id] += r.n_words
    assert max(size.values()) <= 2048 and sum(size.values()) == sum(len((r.text or "").encode().split()) for r in mixed)
    assert max(Counter((r.bin_id, r.doc_id) for r in packed).values()) == 1
    for d in seen.values():
        d.unpersist()


def test_odd_rows_pass_every_stage(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "s", 0), (2, "same text of some words", "en", "s", 23), (2, "same text of some words", "en", "s", 23), (3, "w " * 9000, "en", None, 18000)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() > 0
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, str(tmp_path)).collect() == []
    assert packing.SHARD > 0
