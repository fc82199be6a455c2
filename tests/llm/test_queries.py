"""The registered queries as they are called, over the smallest tables."""

import sys
import zlib
from pathlib import Path

import duckdb
import pytest

from siftlode.llm import queries, quality

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from test_runs import canonical  # noqa: E402

SF = "/root/testdata/sf0.001"
CONTRACT = {
    "op1_language_id": {"doc_id", "held_out", "lang_pred", "score"}, "op2_url_filters": {"page_id", "host", "path", "rule", "verdict"}, "op3_suffix_dedup": {"doc_id"}, "op4_embedding_dedup": {"vec_id", "n_links", "component_id", "kept"},
    "op5_bestfit_packing": {"bin_id", "doc_id"}, "op6_license_scans": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"}, "op7_source_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op12_token_alignment": {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"}, "op13_main_text": {"page_id", "url", "text", "n_chars"}, "op8_quality_gam": {"doc_id", "held_out", "score", "predicted"}, "op11_filter_interactions": {"part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"}, "op9_audio_media": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"}, "op10_simhash": {"doc_id", "fingerprint", "component_id"},
}


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries_return_what_they_promise(spark, docs, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert CONTRACT[name] <= set(got.columns) and set(CONTRACT) == set(queries.QUERIES)
    fold = lambda n: got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % n)
    if name in ("op1_language_id", "op6_license_scans", "op7_source_mixing", "op8_quality_gam", "op9_audio_media", "op10_simhash", "op12_token_alignment"):
        assert sorted(got.doc_id) == sorted(docs)
    if name in ("op1_language_id", "op8_quality_gam"):
        assert (got.held_out == (fold(4) == 2 if name.startswith("op1_") else fold(5) == 0)).all() and got.score.between(0, 1).all()
    if name == "op8_quality_gam":
        assert (got.predicted == (got.score >= 0.3)).all() and got.predicted.nunique() == 2
    if name == "op9_audio_media":
        by = dict(zip(got.doc_id, got.feature, strict=True))
        assert len(set(by.values())) == len({docs[i].text or "" for i in docs})
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        for t in ("documents", "pages", "embeddings", "labels"):
            con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
        want = con.execute(queries.ORACLE_SQL[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)


def test_the_fit_is_bounded_by_rows(spark, monkeypatch):
    rows = [(i % 7, f"text number {i} of this id" if i % 3 else f"### {i} $$$") for i in range(6000)] + [(1, "the same")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)] * 50 + [(None, 1), (3, None)], "doc_id long, quality int")
    seen = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y, **k: seen.append(len(y)) or fit(x, y, rounds=2, n_pairs=0))
    quality.learn(docs, labels, max_rows=500)
    assert 300 < seen[0] < 700
