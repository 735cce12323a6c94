"""Numbers that round to zero have the sign that they have in SQL."""

import math

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from kinetable.plans import catalogue


def signed(x):
    """A value in which -0.0 and 0.0 differ."""
    if isinstance(x, (list, tuple)):
        return tuple(map(signed, x))
    return f"{x:.9f}" if isinstance(x, float) and math.isfinite(x) else repr(x)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Vectors with places just below and above zero."""
    out = tmp_path_factory.mktemp("signs")
    values = [[(-1 if i % 4 == 0 else (-1) ** (i + j)) * (1e-8 if i % 4 == 0 or (i + j) % 3 else 0.25) * (1 + j % 5) for j in range(64)] for i in range(40)]
    t = pa.table({"vec_id": pa.array(range(40)), "embedding": pa.array(values, pa.list_(pa.float32())), "label": pa.array([i % 3 for i in range(40)], pa.int32())})
    pq.write_table(t, f"{out}/embeddings.parquet")
    return str(out)


NAMES = [
    "array_shapes",
    "depth_resize",
    "clean_coordinates",
    "exported_tracks",
    "rolling_forecast",
]


@pytest.mark.parametrize("name", NAMES)
def test_sign_of_zero_as_in_sql(spark, folder, name):
    df = catalogue.QUERIES[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    rows = con.execute("select " + ", ".join(f'"{c}"' for c in df.columns) + f" from ({catalogue.ORACLES[name]}) q").fetchall()
    want = sorted(signed(r) for r in rows)
    assert any("-0.000000000" in repr(r) for r in want)
    assert sorted(signed(tuple(r)) for r in df.collect()) == want
