"""Every catalogue query against its SQL text on DuckDB, over whole tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from flowscope.plans.catalog import QUERIES
from flowscope.plans.oracle import ORACLE

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()
TYPES = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "float": "FLOAT",
    "double": "DOUBLE",
    "date": "DATE",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def _sorted(rows, columns, index):
    return sorted((tuple(_plain(r[index[c]]) for c in columns) for r in rows), key=repr)


def test_every_query_has_an_oracle():
    assert QUERIES.keys() == ORACLE.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    ours = _sorted(df.collect(), columns, {c: c for c in columns})
    result = duck.execute(ORACLE[name])
    header = [d[0] for d in result.description]
    theirs = _sorted(result.fetchall(), columns, {c: header.index(c) for c in columns})
    assert sorted(header) == columns
    assert ours == theirs
    types = {r[0]: r[1] for r in duck.execute(f"describe ({ORACLE[name]})").fetchall()}
    assert {c: TYPES[t] for c, t in df.dtypes} == types
