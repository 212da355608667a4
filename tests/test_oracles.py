"""Every query with SQL gives the same rows in both engines on the smallest shared tables."""

import math
import os

import duckdb
import pytest

from genoframe.plans import registry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the shared tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return str(v)
    return f"{float(v):.6g}" if not float(v).is_integer() else str(int(v))


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in data)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(name, spark, db):
    df = registry.queries()[name](spark, SF)
    want = db.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())
