"""Every query with SQL gives DuckDB's rows at the smallest scale; the others run."""

import glob
import os

import duckdb
import pytest

from quarry import registry

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    found = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    said = duck.execute(registry.ORACLE_SQL[name])
    at = [c[0] for c in said.description]
    assert sorted(at) == columns
    want = sorted((tuple(r[at.index(c)] for c in columns) for r in said.fetchall()), key=repr)
    assert found == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, SMALL)
    rows = df.collect()
    assert all(len(r) == len(df.columns) for r in rows)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
