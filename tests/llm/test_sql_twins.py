"""The queries with a SQL twin on the smallest tables."""

import os

import duckdb
import pytest

pytest.importorskip("public_tokenizers")

from tracelake.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    cur = con.execute(queries.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    want = sorted(tuple(dict(zip(names, r))[c] for c in sorted(names)) for r in cur.fetchall())
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(r[c] for c in sorted(names)) for r in df.collect()) == want


def test_every_operator_has_a_query():
    numbers = {n.split("_")[0] for n in queries.queries()}
    assert numbers == {"pipeline", *(f"op{k}" for k in range(1, 14))}
