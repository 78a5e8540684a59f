"""The registered queries against DuckDB on the test tables."""

import os

import duckdb
import pytest

from tessera import queries

SF = os.environ.get("TESSERA_SF", "/root/testdata/sf0.001")
ORACLE = queries.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in queries.KEYS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    result = duck.execute(ORACLE[name])
    names, want = [d[0] for d in result.description], result.fetchall()
    assert df.columns == names
    key = lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r)
    assert sorted((tuple(map(plain, r)) for r in df.collect()), key=key) == sorted((tuple(map(plain, r)) for r in want), key=key)


def test_entry(spark):
    import __spark_entry__

    assert set(ORACLE) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
