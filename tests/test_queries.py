"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

from chunkloom.registry import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    rel = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(value(r[names.index(c)]) for c in df.columns) for r in rel.fetchall()), key=str)
    got = sorted((tuple(value(x) for x in r) for r in df.collect()), key=str)
    assert got == want


@pytest.mark.parametrize("name", [k for k in QUERIES if k not in ORACLE_SQL])
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())
