"""What only larger tables show, on small tables made for it: high keys, great depths, long contigs."""

import os

import duckdb
import pytest

from genoframe.plans import registry

from .test_oracles import SF, TABLES, rows

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the shared tables are not here")


def tables(folder, **queries):
    """A folder with the smallest shared tables, some of them by a query over them, and a connection that has its views."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW old_{t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for t in TABLES:
        con.execute(f"COPY ({queries.get(t, f'SELECT * FROM old_{t}')}) TO '{folder}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def check(spark, con, folder, name, sql):
    df, want = registry.queries()[name](spark, str(folder)), con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def test_quantized_depth_has_no_top(spark, tmp_path):
    con = tables(tmp_path, lineitem="SELECT l.* FROM (SELECT * FROM old_lineitem LIMIT 200) l, range(1200)")
    check(spark, con, tmp_path, "quantized_depth", registry.oracle_sql()["quantized_depth"])


#: Ids of line items in 128 bits, as DuckDB's 64 overflow from orders of 1.4 million on; the rest of the SQL is as registered.
WIDE = ("(l_orderkey * 10 + l_linenumber) * 1000000", "(l_orderkey::HUGEINT * 10 + l_linenumber) * 1000000")


@pytest.fixture(scope="module")
def high(tmp_path_factory):
    """The smallest tables, and half of the line items with orders that 64 bits of an id can't hold; the remainders that make chromosomes stay."""
    folder = tmp_path_factory.mktemp("high")
    return folder, tables(folder, lineitem="SELECT * REPLACE (l_orderkey + CASE WHEN l_orderkey % 2 = 0 THEN 9000000 ELSE 0 END AS l_orderkey) FROM old_lineitem")


@pytest.mark.parametrize("name", [
    "make_windows", "flank_intervals", "block_intervals", "make_windows_number", "alignment_view", "alignment_fastq",
    "consecutive_groups", "fix_mates", "left_overlap", "fraction_overlap", "either_fraction_overlap", "block_overlap",
    "closest_intervals", "closest_first", "coverage_depth", "coverage_histogram", "closest_three", "cluster_intervals",
    "anti_overlap", "count_overlap", "annotate", "coverage",
])
def test_ids_of_more_than_64_bits(name, spark, high):
    sql = registry.oracle_sql()[name]
    assert WIDE[0] in sql
    check(spark, high[1], high[0], name, sql.replace(*WIDE))
