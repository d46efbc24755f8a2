"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest
from provlake import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(queries.ORACLES[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert sorted(map(str, [tuple(r[c] for c in cols) for r in df.collect()])) == sorted(map(str, [tuple(r[i] for i in at) for r in want.fetchall()]))
