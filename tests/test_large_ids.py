"""Queries on ids and files that small tables don't have."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from kinetable.plans import catalogue
from kinetable.sources import hdf5


def same(spark, folder, name, table):
    df = catalogue.QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    want = con.execute("select " + ", ".join(f'"{c}"' for c in df.columns) + f" from ({catalogue.ORACLES[name]}) q").fetchall()
    got = sorted(map(tuple, df.collect()), key=repr)
    assert len(got) > 0 and got == sorted(want, key=repr)


def vectors(folder, ids, embedding):
    t = pa.table({"vec_id": pa.array(ids), "embedding": pa.array(embedding, pa.list_(pa.float32())), "label": pa.array([i % 2 for i in ids], pa.int32())})
    pq.write_table(t, f"{folder}/embeddings.parquet")


def test_frames_of_six_digits(spark, tmp_path):
    ids = [2, 3, 99_999, 100_002, 100_005, 1_200_003]
    vectors(tmp_path, ids, [[(i % 7 + k) / 16 for k in range(64)] for i in ids])
    same(spark, tmp_path, "exr_depth", "embeddings")


def test_rows_of_chunks_are_read_once(spark, tmp_path):
    rng = np.random.default_rng(1)
    want = np.arange(3, 2000, 4).tolist()
    asked = {}
    for n in (500, 2000):
        values = rng.integers(0, 60_000, (n, 8, 8)).astype(np.uint16)
        w = hdf5.Writer()
        data, count = w.finish(w.group({"depth": w.array(values, (3, 5, 8))})), [0]

        def read(begin, size, data=data, count=count):
            count[0] += 1
            return data[begin : begin + size]

        got = dict(hdf5.File(read).picked("depth", [-1, *want, 2001]))
        assert sorted(got) == [r for r in want if r < n] and all((got[r] == values[r]).all() for r in got)
        asked[n] = count[0]
        f = hdf5.File(read)
        for begin, end in ((n // 2 + 1, n // 2 + 3), (0, n), (191, 194), (n - 1, n)):  # 64 chunks are a branch
            assert (f.rows("depth", begin, end) == values[begin:end]).all()
        for r in range(n):
            assert (next(f.picked("depth", [r]))[1] == values[r]).all()
    assert asked[2000] < 4.5 * asked[500]


def test_millimetres_round_halves_up(spark, tmp_path):
    vectors(tmp_path, range(8), [[(0.0625 if k % 2 else 0.1875) + i / 8 for k in range(64)] for i in range(8)])
    same(spark, tmp_path, "hdf5_depth", "embeddings")
