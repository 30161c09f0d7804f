"""The registered queries: all fourteen, and their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_mod
from scripts.check_oracle import rows_canon
from spanlake.llm.queries import ORACLE, QUERIES
from spanlake.sources.tables import TABLES


def test_one_query_for_each_operator_and_the_pipeline():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry_mod.queries())
    assert set(ORACLE) <= set(entry_mod.oracle_sql()) and "pipeline" not in entry_mod.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, sf_small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_small}/{t}.parquet')")
    df = QUERIES[name](spark, sf_small)
    res = con.execute(ORACLE[name])
    columns = [c[0] for c in res.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_canon(df.columns, [tuple(r) for r in df.collect()]) == rows_canon(columns, res.fetchall())
