"""Every registered query against its comparison SQL, at the smallest scale."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from docspark.plans.oracle import ORACLE
from docspark.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    quoted = [f'"{c}"' for c in columns]
    want = duck.execute(f"SELECT {', '.join(quoted)} FROM ({ORACLE[name]})").fetchall()
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["job_id", "merchant", "row_count", "total_amount", "total"]
    assert df.filter("row_count > 0").count() > 0
