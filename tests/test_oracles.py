"""Every query with SQL against DuckDB on the smallest tables, and the rest for rows."""

import os

import duckdb
import pytest

from quakeframe.plans import catalogue

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.6f}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(x) for x in r) for r in df.select(*cols).collect())
    if name not in catalogue.ORACLES:
        assert got
        return
    r = duck.execute(catalogue.ORACLES[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(row[names.index(c)]) for c in cols) for row in r.fetchall())
    assert got == want
