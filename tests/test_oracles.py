"""Every registered query runs, and those with SQL agree with it, at the smallest scale."""

from collections import Counter

import duckdb
import pytest

from marlstone.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def _text(x):
    return "None" if x is None or x != x else str(x)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf, duck, name):
    got = registry.queries()[name](spark, sf)
    rows = got.toPandas()
    if name not in registry.oracle_sql():
        assert len(rows) > 0
        return
    want = duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(want.columns) == sorted(rows.columns)
    counted = lambda d: Counter(tuple(map(_text, r)) for r in d[sorted(want.columns)].astype(object).values.tolist())
    assert counted(rows) == counted(want)


def test_entry_module_stands_without_the_subpackage(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "_llm", lambda: None)
    assert set(entry.queries()) == set(registry.queries()) and set(entry.oracle_sql()) == set(registry.oracle_sql())
