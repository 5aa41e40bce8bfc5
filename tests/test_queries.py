"""Every query with SQL of its own gives the rows that DuckDB gives."""

import duckdb
import pytest

from corroborate.plans.carriers import TABLES
from corroborate.plans.oracles import ORACLES
from corroborate.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    fixed = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted(str([fixed(r[i]) for i in order]) for r in found)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    got = rows(df.columns, df.collect())
    assert got == rows(names, want.fetchall())
    assert got


def test_each_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
