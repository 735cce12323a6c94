"""Nearest rows to a set of queries, exactly: rows stay where they are, and queries go to them in
blocks as large as BLOCK_BYTES allows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of the queries that are sent to all tasks at once (the rows are read once for each such
#: block), and queries and rows whose distances are held at once.
BLOCK_BYTES, QUERIES, ROWS = 64 << 20, 512, 4096


def _merged(q: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each query among candidates (query, distance, id), of equals the smaller id."""
    order = np.lexsort((ids, d, q))
    q, d, ids = q[order], d[order], ids[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    nth = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return q[nth < k], d[nth < k], ids[nth < k]


class Nearest:
    """The k nearest rows that a task has met, of each query of a block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.v, self.k = ids, vectors, k
        self.norm = (vectors * vectors).sum(1)
        self.found = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.reach = np.full(len(ids), np.inf)  # the k-th distance so far, squared

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        norm, new = (x * x).sum(1), [self.found]
        for a in range(0, len(self.ids), QUERIES):
            v = self.v[a : a + QUERIES]
            scale = self.norm[a : a + QUERIES, None] + norm
            d = scale - 2 * (v @ x.T)
            reach = self.reach[a : a + QUERIES]
            if x.shape[0] > self.k + 1:  # one more than k: the row itself may be among them
                reach = np.minimum(reach, np.partition(d, self.k, 1)[:, self.k])
            q, r = np.nonzero(d <= reach[:, None] + 1e-9 * (scale + 1))  # rounding loses none
            own = self.ids[a + q] != ids[r]
            q, r = q[own], r[own]
            new.append((a + q, np.sqrt(((x[r] - v[q]) ** 2).sum(1)), ids[r]))
        self.found = _merged(*[np.concatenate(c) for c in zip(*new, strict=True)], self.k)
        q, d, _ = self.found
        n = np.bincount(q, minlength=len(self.ids))
        last = np.cumsum(n)[n >= self.k] - 1
        self.reach[n >= self.k] = d[last] ** 2


def nearest_rows(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(q, key, d, n): the k nearest rows of each query but the row itself, by distance and then
    key. Each task gives its own k best, so what is shuffled is k rows a query and task. Rows and
    queries with a null key or vector are left out."""
    spark, out = rows.sparkSession, None
    queries, rows = (df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias(vector)) for df in (queries, rows))
    size = queries.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("d")).first()
    blocks = max(1, math.ceil(size["n"] * 8 * ((size["d"] or 0) + 1) / BLOCK_BYTES))
    for b in range(blocks):
        own = queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).collect()
        if not own:
            continue
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in own], np.int64), np.array([r[1] for r in own], np.float64)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = Nearest(*shared.value, k)
            for batch in batches:
                for a in range(0, batch.num_rows, ROWS):
                    part = batch.slice(a, ROWS)
                    best.add(part.column(0).to_numpy(), part.column(1).flatten().to_numpy().reshape(part.num_rows, -1))
            q, d, ids = best.found
            yield pa.RecordBatch.from_arrays([pa.array(best.ids[q]), pa.array(ids), pa.array(d)], ["q", key, "d"])

        part = rows.mapInArrow(run, f"q long, {key} long, d double")
        out = part if out is None else out.unionByName(part)
    n = F.row_number().over(Window.partitionBy("q").orderBy("d", key))
    if out is None:
        out = spark.createDataFrame([], f"q long, {key} long, d double")
    return out.withColumn("n", n.cast("long")).where(F.col("n") <= k)
