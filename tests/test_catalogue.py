"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"

if not os.path.isdir(SF):
    pytest.skip("no test tables", allow_module_level=True)

from docloom.plans import catalogue  # noqa: E402


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    r = con.execute(catalogue.oracle_sql()[name])
    columns = [x[0] for x in r.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(repr(tuple(x)) for x in r.fetchall())
    assert sorted(repr(tuple(x)) for x in df.select(*columns).collect()) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
