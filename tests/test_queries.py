"""Every registered query with a DuckDB form against it, and that none is empty."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
EMPTY = {"alerts", "reorg_affected_txs", "reorg_detect", "wallet_page"}  # may be empty on the smallest data
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_agrees_with_duckdb(spark, db, name):
    got = entry.queries()[name](spark, SF)
    want = db.execute(ORACLE[name])
    cols = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(cols)
    rows, expected = plain(map(tuple, got.select(*cols).collect())), plain(want.fetchall())
    assert rows == expected
    assert rows or name in EMPTY


def test_entry(spark):
    assert entry.entry(spark).count() > 0
