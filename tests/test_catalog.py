"""Each query of the engine's own runs on the smallest tables; those with SQL agree with it."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from sievemill import catalog


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return [plain(x) for x in v] if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, name):
    made = catalog.queries()[name](spark, sf_dir)
    rows = made.collect()
    sql = catalog.oracle_sql().get(name)
    if not sql:
        assert made.columns
        return
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(made.columns)
    order = [names.index(c) for c in made.columns]
    assert sorted(repr([plain(x) for x in r]) for r in rows) == sorted(repr([plain(r[i]) for i in order]) for r in cursor.fetchall())


def test_entry(spark):
    made = entry.entry(spark)
    assert made.columns and made.count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
