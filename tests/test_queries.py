"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import math
from collections import Counter

import duckdb
import pytest

from trialframe import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else repr(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = Counter(tuple(map(plain, r)) for r in df.select(*cols).collect())
    cur = duck.execute(catalog.ORACLES[name])
    order = sorted(range(len(cols)), key=lambda i: cur.description[i][0])
    assert [cur.description[i][0] for i in order] == cols
    assert got == Counter(tuple(plain(r[i]) for i in order) for r in cur.fetchall())


def test_entry_registers_everything(spark):
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["arm", "exact", "safe", "agreement", "rank", "winner"]
