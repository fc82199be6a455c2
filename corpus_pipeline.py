"""The corpus pipeline: five stages over documents, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlode.llm import langid, minhash, mixing, packing, quality, suffixes
from siftlode.llm.common import cut, drop, swept

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model scores at 0.3 or more.  It learns from the labels outside fold 0.

    Every row is scored by its text alone, so repeated rows stay or go together; null and empty texts
    have the score of no features, and null ids pass like others.  Without labels every score is 0.5 and
    all rows stay.  An empty table gives no rows; other columns, whatever their names, are kept."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(langid.fold(F.col("doc_id"), 5) != 0)
    model = quality.learn(docs, labels)
    scored = quality.score(docs, model, keep=tuple(docs.columns), into="__quality")
    return scored.where("__quality >= 0.3").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of near copies (5-word Jaccard 0.8, or the SimHash rule): that of the smallest doc_id.

    Null ids come last, ties go by a hash of the text, and of rows equal in id and text one stays.  Null
    and empty texts have fingerprint zero and are one set.  An empty table gives no rows; other columns
    are kept."""
    return minhash.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages of 50 words or more are cut; n_chars follows the text.

    The first copy, in the document that comes first by id (null ids last), stays.  Null, empty and short
    texts pass; a document of which nothing is left goes; repeated rows are treated alike.  An empty table
    gives no rows; other columns are kept."""
    return suffixes.remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's target asks for, three times at most.

    Null sources are one source.  Which rows are taken once more goes by a hash of id and text, so rows
    equal in both are treated alike within a source, whatever other sources hold.  Null and empty texts
    have no words and cost no budget.  An empty table gives no rows; other columns are kept."""
    return mixing.mixed(docs)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of 2048 words; copies that the mix repeats are of one cluster and never share a bin.

    Null and empty texts are pieces of no words, null ids pieces of their own; ties in size go by cluster
    and id.  An empty table gives no rows; of other columns only `source` counts."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("simhash", drop_near_duplicates),
    ("suffixes", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_bins),
]

#: No stage but the mix's sums can be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is a table that the next one reads.  The tables between
    the steps of a stage go when its own is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        with swept(spark) as keep:
            done = cut(stage(spark, docs, sf_dir))
            keep(done)
        drop(docs)
        docs = done
    return docs
