"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest
from hostlake.plans.oracle import ORACLE
from hostlake.plans.queries import QUERIES

LIGHT = [n for n in ORACLE if n[:4] in {"s001", "s002", "s004", "s014", "s015", "s016", "s018", "s020", "s023", "s025", "s026", "s028", "s032", "s033", "s034", "s035", "s036", "s038", "s039", "s043", "s045", "s046", "s048", "s057", "s062", "s067", "s069", "s071", "s072", "s075", "s076", "s080", "s085", "s094", "s095", "s096", "s099", "s100", "s104", "s109", "s113", "s117"}]


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", LIGHT)
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    cursor = con.execute(ORACLE[name])
    columns = sorted(d[0] for d in cursor.description)
    order = [[d[0] for d in cursor.description].index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=str)
    df = QUERIES[name](spark, sf)
    assert sorted(df.columns) == columns
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str) == want


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns[:2] == ["pid", "wid"]
