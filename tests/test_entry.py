"""Every registered query of the event engine on the smallest tables, against DuckDB where there is SQL."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry
from formicary.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(str(tuple(float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    out = QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    rows = [tuple(r) for r in out.select(*columns).collect()]
    assert rows
    if name in ORACLE_SQL:
        duck = duckdb.connect()
        duck.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
        want = duck.sql("SELECT {} FROM ({})".format(", ".join(f'"{c}"' for c in columns), ORACLE_SQL[name])).fetchall()
        assert plain(rows) == plain(want)
    for r in rows:
        assert not any(isinstance(v, float) and math.isnan(v) for v in r)


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
