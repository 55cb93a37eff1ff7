import os

import duckdb
import pytest

from lettermill.plans.catalogue import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE[name]).df()
    cols = sorted(ours.columns)
    assert cols == sorted(theirs.columns)
    rows = lambda d: sorted(map(repr, d[cols].itertuples(index=False, name=None)))
    assert rows(ours.astype(object)) == rows(theirs.astype(object))
