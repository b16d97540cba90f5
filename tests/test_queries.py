"""Every query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from gridloom.plans import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def rows(frame, cols, floats):
    frame = frame[cols].copy()
    for c in floats:
        frame[c] = frame[c].astype(float)
    frame = frame.astype(object).where(frame.notna(), None)
    return sorted(map(str, frame.values.tolist()))


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_matches_sql(spark, duck, name):
    mine, its = Q.QUERIES[name](spark, SF).toPandas(), duck.sql(Q.ORACLE[name]).df()
    cols = sorted(mine.columns)
    assert cols == sorted(its.columns)
    floats = [c for c in cols if "float" in (str(mine[c].dtype) + str(its[c].dtype))]
    assert rows(mine, cols, floats) == rows(its, cols, floats)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE)))
def test_without_sql(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0
