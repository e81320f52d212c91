"""The corpus pipeline: documents in, token ids of a deduplicated and mixed corpus out.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; it is written
as Parquet and read again as the next stage's docs, and goes once that one is written. All
but the last return the columns of ``documents``, extra ones too. The classifier is fitted
to the labelled rows of its own input; no other stage learns anything.

Defined results: an empty table passes all stages as an empty one. Rows with a null text
are the empty text; the mix takes none of it. Null ids, langs and sources are kept as they
are. What each stage makes of odd rows beyond that stands in its operator's module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import bpe, exact_dedup, jaccard, mixing, quality
from tidelog.llm.common import Scratch, staged, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that probably have a good grade stay; without labels all do."""
    return quality.keep_good(docs, quality.learned(docs, table(spark, sf_dir, "labels")))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts stays, that with the largest id; a null id is the least, and one of repeated rows stays."""
    return exact_dedup.drop_copies(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each component of documents with a five-word shingle similarity of 0.8 or more stays, that with the least id; a null id is the greatest, and texts without words all stay."""
    return jaccard.keep_one(docs, words=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares: a document comes as often as the mix takes it, which is not at all, once or twice. Texts without words go; null is a source."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, none for an empty one, and the digest of what they decode to."""
    return bpe.round_trip(docs, ids=True).select("doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256")


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_duplicates),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", encode),
]

#: SQL can't express the classifier; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), Scratch()
    for _, stage in STAGES[:-1]:
        own = Scratch()
        docs = staged(stage(spark, docs, sf_dir), own)
        before.drop()
        before = own
    return STAGES[-1][1](spark, docs, sf_dir)
