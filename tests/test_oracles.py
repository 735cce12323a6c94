"""Every query with an oracle gives the same rows, columns and types in DuckDB."""

import math
import os

import duckdb
import numpy as np
import pytest

from kinetable.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TYPES = {"array<bigint>": "BIGINT[]", "array<int>": "INTEGER[]", "array<double>": "DOUBLE[]", "array<string>": "VARCHAR[]", "array<boolean>": "BOOLEAN[]", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    return con


def plain(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(map(plain, x))
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    return x


@pytest.mark.parametrize("name", sorted(set(catalogue.ORACLES)))
def test_same_as_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    want = duck.sql(catalogue.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    for f in df.schema:
        assert TYPES.get(f.dataType.simpleString(), kinds[f.name]) == kinds[f.name], f.name
    at = [want.columns.index(c) for c in cols]
    a = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert a == b
