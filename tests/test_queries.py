"""Every query of the document engine against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from vellum.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda x: float(x) if isinstance(x, float) else x
    return sorted((repr(tuple(plain(r[i]) for i in order)) for r in rows))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    assert name in catalogue.ORACLES
    df = catalogue.QUERIES[name](spark, SF)
    found = df.collect()
    sql = db.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in sql.description]
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.columns, [tuple(r) for r in found]) == _rows(columns, sql.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(catalogue.ORACLES) <= set(entry.oracle_sql())
