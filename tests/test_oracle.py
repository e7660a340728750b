"""Registered queries against DuckDB on the smallest tables."""

import duckdb
import pytest

from duelgrid.plans.oracle import ORACLE_SQL
from duelgrid.plans.queries import QUERIES

NAMES = sorted(ORACLE_SQL)


def cell(value):
    if value is None or value != value:
        return "null"
    return f"{float(value):.6f}" if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in ("customer", "orders", "lineitem", "supplier", "nation"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, sf, duck, name):
    found = QUERIES[name](spark, sf)
    wanted = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in wanted.description]
    assert sorted(columns) == sorted(found.columns)
    assert as_rows(found.columns, found.collect()) == as_rows(columns, wanted.fetchall())


def test_every_query_is_registered_with_known_names():
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLE_SQL) == {"epa_sensitivity", "coefficient_uncertainty", "ridge_win", "ridge_severity", "ordinal_fit", "weekly_scores", "model_rating_draws"}
