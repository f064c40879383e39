"""Every query that has SQL gives DuckDB's rows on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from sparquill.plans import catalog, catalog_ingest, catalog_labels, catalog_runs, catalog_samples, catalog_study  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.8g}"
    return str(v)


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{tiny}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, tiny, duck, name):
    df = catalog.QUERIES[name](spark, tiny)
    rel = duck.sql(catalog.SQL[name])
    cols = sorted(rel.columns)
    assert sorted(df.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_entry_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and "backtest_summary" in entry.queries()


def test_sql_is_text():
    import __spark_entry__ as entry

    assert all(isinstance(x, str) for x in entry.oracle_sql().values())
