"""Every registered query against its DuckDB oracle on sf0.001 (the driver
checks sf0.01 the same way)."""
import duckdb
import pytest

import __spark_entry__ as entry
from castwork.plans.queries import QUERIES
from tools.check import TABLES, digest

SF = "/root/testdata/sf0.001"
KEYS = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_own_query_is_registered_with_an_oracle():
    """The library's own keys; those of the training-data operators are tested with them."""
    assert set(QUERIES) <= set(entry.queries()) and set(QUERIES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck, key):
    df = entry.queries()[key](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    res = duck.execute(entry.oracle_sql()[key])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(df.columns, srows, False)[0] == digest(dcols, drows, False)[0]


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and "verdict" in df.columns
