"""Every registered query with an oracle gives what DuckDB gives on the smallest tables."""

import duckdb
import pytest

from sparkdesk.registry import oracles, registered
from tools.check import TABLES, rows

SF_DIR = "/root/testdata/sf0.001"
ORACLES = oracles()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    df = registered()[name](spark, SF_DIR)
    cur = duck.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(cols, cur.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(registered())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
