"""Queries against their SQL on rows of the larger test tables on which they once differed."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

FROM = "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(FROM), reason="the test tables are not here")


def both(spark, top, name, keep):
    """Rows of a query and of its SQL over the tables of which ``keep`` (table -> condition) says the rows."""
    con = duckdb.connect()
    for table, where in keep.items():
        con.execute(f"COPY (SELECT * FROM '{FROM}/{table}.parquet' WHERE {where}) TO '{top}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{top}/{table}.parquet'")
    df = entry.queries()[name](spark, str(top))
    cur = con.execute(entry.oracle_sql()[name])
    order = [x[0] for x in cur.description]
    return sorted(tuple(r[c] for c in order) for r in df.collect()), sorted(cur.fetchall())


# the ratio of this order's trace is 6.96 / 48.0, in the middle between two roundings, and its blocking time a sum of four
@pytest.mark.parametrize("name", ["critical_path_blocking", "critical_path_contributions"])
def test_ratios_between_two_roundings(spark, tmp_path, name):
    got, want = both(spark, tmp_path, name, {"orders": "o_orderkey = 64290", "lineitem": "l_orderkey = 64290"})
    assert got and got == want


def test_the_stream_counts_every_event(spark, tmp_path):
    got, want = both(spark, tmp_path, "stream_log_patterns", {"events": "event_id < 3000"})
    assert got == want
    rows = entry.queries()["stream_log_patterns"](spark, str(tmp_path)).agg({"occurrence_count": "sum"}).first()[0]
    assert rows == spark.read.parquet(f"{tmp_path}/events.parquet").count()
