"""Each query against its SQL."""

import duckdb
import pytest

from docgraph import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events".split():
        c.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return c


def rounded(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    if name not in queries.ORACLES:
        assert df.count() > 0
        return
    want = con.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rounded(tuple(r[c] for c in want.columns) for r in df.collect()) == rounded(want.fetchall())
