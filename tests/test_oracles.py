"""Every query that SQL can express, against DuckDB on the same tables."""
from __future__ import annotations

import os

import duckdb
import pytest

from netweft.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet{'/*' if os.path.isdir(f'{data}/{t}.parquet') else ''}'")
    return con


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, sql, data, name):
    df = catalog.QUERIES[name](spark, data)
    result = sql.execute(catalog.ORACLES[name])
    names, kinds = [c[0] for c in result.description], [str(c[1]) for c in result.description]
    assert sorted(df.columns) == sorted(names)
    assert {c: KINDS[k] for c, k in df.dtypes} == dict(zip(names, kinds))
    want = [tuple(row[names.index(c)] for c in df.columns) for row in result.fetchall()]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in df.collect())
