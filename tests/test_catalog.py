"""Every query that has SQL gives the same rows as DuckDB on the same tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from tidelog.plans import catalog

SF = "/root/testdata/sf0.01"


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


def oracle(sql, sf=SF):
    c = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c.sql(sql).df()


@pytest.mark.parametrize("name", catalog.ORACLES)
def test_matches_sql(spark, name):
    mine, want = catalog.QUERIES[name](spark, SF).toPandas(), oracle(catalog.ORACLES[name])
    assert sorted(mine.columns) == sorted(want.columns)
    assert rows(mine) == rows(want)


def test_headline_figures(spark):
    count = lambda name: catalog.QUERIES[name](spark, SF).count()
    assert (count("kv_heads"), count("kv_live"), count("kv_tombstoned"), count("tier_get_fallthrough")) == (150, 120, 30, 147)
    assert catalog.QUERIES["space_amp"](spark, SF).first().stored_entries == 540


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_prefix_lengths_by_hand(spark):
    import os.path

    got = {r.run: r.shared_bytes for r in catalog.prefix_lengths(spark, "/root/testdata/sf0.001").collect()}
    entries = [(str(r.k), r.seq, r.op, r.seq // 75) for r in catalog.events(spark, "/root/testdata/sf0.001").collect()]
    for run in {e[3] for e in entries}:
        keys = [e[0] for e in sorted((e for e in entries if e[3] == run), key=lambda e: (e[0], -e[1], -e[2]))]
        assert got[run] == sum(len(os.path.commonprefix([a, b])) for i, (a, b) in enumerate(zip(keys, keys[1:], strict=False), 1) if i % 12)
