"""Every registered query against its SQL over the smallest tables."""

import os

import duckdb
import pytest

from braidframe.plans.catalog import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def shown(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    return repr(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLES:
        assert columns
        return
    cur = con.execute(ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(shown(r[i]) for i in at) for r in cur.fetchall())
