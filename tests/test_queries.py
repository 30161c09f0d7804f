"""Every registered query against its DuckDB oracle on the smallest tables, plus
the driver contract (entry, names, column names)."""

import duckdb
import pytest

import __spark_entry__ as entry_mod
from scripts.check_oracle import rows_canon
from spanlake.sources.tables import TABLES

QUERIES = entry_mod.registry.queries()
ORACLE = entry_mod.registry.oracle_sql()


def test_contract(spark):
    df = entry_mod.entry(spark)
    assert df.columns == ["id", "question", "context"]
    assert df.count() >= 0
    assert set(ORACLE) <= set(QUERIES)


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_small}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, duck, sf_small, name):
    df = QUERIES[name](spark, sf_small)
    scols, srows = df.columns, [tuple(r) for r in df.collect()]
    res = duck.execute(ORACLE[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(scols) == sorted(dcols)
    assert rows_canon(scols, srows) == rows_canon(dcols, drows)
