"""Operators that hold a few rows at a time, or none, however many come at once."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from kinetable.operators import interleave
from kinetable.plans import catalogue
from kinetable.sources import pictures


def test_tiling_has_no_shuffle(spark, tmp_path):
    t = pa.table({"p_partkey": pa.array(range(1000)), "p_size": pa.array([i % 50 for i in range(1000)], pa.int32())})
    pq.write_table(t, f"{tmp_path}/part.parquet")
    df = catalogue.QUERIES["tiling"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and df.count() == 1000


def test_pictures_come_a_few_at_once():
    b = pa.RecordBatch.from_arrays([pa.array(range(150))], ["a"])
    got = list(pictures.few(iter([b])))
    assert max(x.num_rows for x in got) <= pictures.FEW and np.concatenate([x.column(0).to_numpy() for x in got]).tolist() == list(range(150))


def test_patches_of_more_rows_than_are_held(spark):
    n = 2 * interleave.FEW + 3
    rows = [(i, [7] * (i % 4) + [-1] * (i % 2) if i % 5 else None, [1] * (i % 4 + i % 2) if i % 5 else None, [(1 + i % 3, 2)] * (i % 2) if i % 5 else None) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, i array<long>, l array<long>, g array<struct<h int, w int>>").coalesce(1)
    got = {r["k"]: r for r in interleave.interleaved(df, "k", "i", "l", "g").collect()}
    assert len(got) == n
    for k, i, x, g in rows:
        t, loss, index = interleave.sequence(np.array(i or [], np.int64), np.array(x or [], np.int64), list(g or []), (2, 2), interleave.Marks())
        assert got[k]["input_tokens"] == t[:-1].tolist() and got[k]["loss_masks"] == loss[1:].tolist() and got[k]["pooled"] == index.tolist()
