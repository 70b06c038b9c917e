"""Every registered query equals its DuckDB oracle on the smallest test tables (names, types, exact values)."""

import importlib
import math

import duckdb
import pytest

E = importlib.import_module("__spark_entry__")
SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations"]
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
         "boolean": "BOOLEAN"}


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (1, "nan") if math.isnan(v) else (2, repr(v))
    return (3, v.isoformat()) if hasattr(v, "isoformat") else (4, str(v))


def _rows(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in records)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, key):
    df = E.queries()[key](spark, SF)
    got = [tuple(r) for r in df.collect()]
    res = duck.execute(E.oracle_sql()[key])
    cols = [d[0] for d in res.description]
    types = {d[0]: str(d[1]) for d in res.description}
    assert sorted(df.columns) == sorted(cols)
    assert {f.name: TYPES.get(f.dataType.simpleString()) for f in df.schema.fields} == types
    assert _rows(df.columns, got) == _rows(cols, res.fetchall())
