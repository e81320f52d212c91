import glob
import os

import duckdb
import pytest

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture
def tables(spark, tmp_path):
    """Write tables given as DataFrames to a folder that queries can read."""

    def write(**frames):
        for name, frame in frames.items():
            frame.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def rows(frame):
    """Sorted rows, columns by name, of a Spark DataFrame or of an oracle's answer."""
    found = frame.select(*sorted(frame.columns))
    return sorted((tuple(r) for r in (found.collect() if hasattr(found, "collect") else found.fetchall())), key=repr)


def oracle(sql, sf=SF):
    c = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        part = f"{path}/*.parquet" if os.path.isdir(path) else path
        c.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{part}'")
    return c.sql(sql)


#: Names that operators use within or add; a user's columns may have them too.
CLASHING = [
    "row", "at", "text_", "tie", "id", "id_", "key", "shard", "place", "deal", "found", "kept", "spans", "size", "Target", "taken", "Keep_ID", "score", "Predicted", "keep", "expected_grade", "LANG_PRED",
    "lang_shares", "n_words", "N_Removed", "ids", "n_tokens", "host", "PATH", "rule", "verdict", "__digest", "__row", "__maybe", "__kept", "__spans", "__lang", "__quality", "__text", "__tie", "__host", "a.b",
]


def clashing(frame):
    """``frame`` with a column of each of these names, which holds that name."""
    from pyspark.sql import functions as F

    return frame.select("*", *[F.lit(c).alias(c) for c in CLASHING])


def unharmed(frame, but=()):
    """Whether the clashing columns, but those that the operator replaces, still hold their names."""
    gone = {c.lower() for c in but}
    kept = [c for c in CLASHING if c.lower() not in gone]
    assert [c for c in frame.columns if c in kept] == kept
    found = frame.select(*[f"`{c}`" for c in kept]).collect()
    return all(list(r) == kept for r in found)


def odd_documents(spark):
    """Nulls in each column, empty, blank and long texts, repeated rows, equal texts."""
    long = " ".join(f"word{i % 977}" for i in range(30000))
    return spark.createDataFrame(
        [
            (1, "The same text here", "en", "a", 18), (2, "THE same text here", "en", "b", 18), (3, None, "en", "a", 0), (4, "", None, None, None), (5, " \t\n", "de", "c", 3),
            (6, long, "en", "a", len(long)), (7, long, "en", None, len(long)), (8, "éÀ only ÀÉ", "fr", "b", 9), (8, "éÀ only ÀÉ", "fr", "b", 9), (None, "no id", "en", "a", 5),
            (None, None, None, None, None), (9, "x", "en", "a", 1), (10, "12 34 !!", "en", "a", 8), (11, "a" * 30000, "en", "a", 30000),
        ],
        DOCUMENTS,
    )
