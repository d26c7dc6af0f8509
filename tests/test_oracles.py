"""Every registered graph query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from graphloom.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        want = con.sql(ORACLES[name]).df()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        frames = [x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want)]
        assert frames[0].equals(frames[1])
