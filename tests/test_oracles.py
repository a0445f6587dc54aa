"""Every query against its SQL twin on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

from barlattice.plans import catalog

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v + 0.0, 6) + 0.0
    return v if v is None or isinstance(v, (bool, int)) else str(v)


def same(spark, duck, function, sql):
    df = function(spark, SMALL)
    names = sorted(df.columns)
    relation = duck.sql(sql)
    assert sorted(relation.columns) == names
    places = [relation.columns.index(n) for n in names]
    got = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    want = Counter(tuple(plain(r[i]) for i in places) for r in relation.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, duck, name):
    same(spark, duck, catalog.QUERIES[name], catalog.ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
