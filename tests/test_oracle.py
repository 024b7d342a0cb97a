"""Every query with a SQL twin against DuckDB on the smallest tables."""

import datetime
import decimal
import math
import os
from pathlib import Path

import duckdb
import pytest

from tracelake.queries import documents, faults, fleet, more, plans, ranges, rollups, signals, traces

SF = "/root/testdata/sf0.001"
ALL = fleet.QUERIES | traces.QUERIES | signals.QUERIES | documents.QUERIES | plans.QUERIES | faults.QUERIES | more.QUERIES | ranges.QUERIES | rollups.QUERIES
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in ALL.items() if sql))
def test_same_rows_as_sql(spark, con, name):
    query, sql = ALL[name]
    df = query(spark, SF)
    cols = sorted(df.columns)
    got = sorted([tuple(plain(r[c]) for c in cols) for r in df.collect()], key=lambda r: tuple(map(str, r)))
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = sorted([tuple(plain(dict(zip(names, r))[c]) for c in cols) for r in cur.fetchall()], key=lambda r: tuple(map(str, r)))
    assert got == want
