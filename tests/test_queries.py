"""Every query with SQL against DuckDB on the smallest tables; every other query runs and keeps its schema."""

import os

import duckdb
import pytest

from granary.plans import registry

FOLDER = os.environ.get("GRANARY_TABLES", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ENTRIES = registry.entries()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return repr(v + 0.0)
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("key", [k for k, e in ENTRIES.items() if e.sql is not None])
def test_equals_sql(spark, duck, key):
    df = ENTRIES[key].run(spark, FOLDER)
    want = duck.sql(ENTRIES[key].sql)
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(n) for n in names]
    assert sorted(tuple(plain(r[n]) for n in names) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("key", [k for k, e in ENTRIES.items() if e.sql is None])
def test_runs(spark, key):
    df = ENTRIES[key].run(spark, FOLDER)
    assert len(df.columns) == len(set(df.columns))
    df.collect()


def test_inventory_is_covered():
    ids = {i for e in ENTRIES.values() for i in e.ids}
    #: Sinks, sources and surfaces that have no rows to return; tests/test_sources.py covers those with an effect.
    other = set()
    every = {f"{k}{i}" for k, n in dict(S=27, F=58, P=8, J=12, A=27, W=10, T=12, U=6, G=16, M=27).items() for i in range(1, n + 1)}
    assert every - ids - other == set()
