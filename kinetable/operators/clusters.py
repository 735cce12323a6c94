"""K-means with parallel seeding, a plan for each pass over the points.

Seeds: the point with the least hash, then in each of a few rounds every point whose hash falls
below a share that grows with its squared distance to the seeds so far; of all these the k that
most points are nearest to. Then points go to their nearest centre, and centres to the mean of
their points, a fixed number of times. Draws depend on ids alone, so the result is the same at
every partitioning. What goes to tasks and comes back are seeds and centres, whose number is
bounded by k and the rounds; points stay where they are.

Rows: points with a null id or vector are left out; equal distances go to the earlier centre; an
empty cluster keeps its centre; fewer seeds than k give as many clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points of a block whose distances are held at once; distances this close are made again exactly.
BLOCK, CLOSE = 4096, 1e-9


def draw(key: Column, nth: int) -> Column:
    """A number in (0, 1) from a point's id and the round."""
    digest = F.sha2(F.concat_ws(":", key.cast("string"), F.lit(str(nth))).cast("binary"), 256)
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each point the nearest centre, the first of equals, and its squared distance."""
    d = np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1) - 2 * (x @ centres.T), 0)
    at = d.argmin(1)
    close = d <= d.min(1)[:, None] + CLOSE
    for i in np.flatnonzero(close.sum(1) > 1):
        j = np.flatnonzero(close[i])
        at[i] = j[((x[i] - centres[j]) ** 2).sum(1).argmin()]
    return at, ((x - centres[at]) ** 2).sum(1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for k in range(0, batch.num_rows, BLOCK):
            b = batch.slice(k, BLOCK)
            yield b, np.asarray(b.column(1).flatten(), float).reshape(b.num_rows, -1)


def placed(points: DataFrame, centres: np.ndarray) -> DataFrame:
    """(id, vector, cluster, d2, ...) of points (id, vector, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _blocks(batches):
            at, d2 = nearest(x, centres)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int64()), pa.array(d2)], [*b.schema.names, "cluster", "d2"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)
    return points.mapInArrow(run, f"{kinds}, cluster long, d2 double")


def means(points: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The means of the points nearest to each centre: sums are made where the points are, a row
    for each centre and task comes together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centres), np.int64), np.zeros(centres.shape)
        for _, x in _blocks(batches):
            at, _ = nearest(x, centres)
            n += np.bincount(at, minlength=len(centres))
            np.add.at(total, at, x)
        has = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(has, pa.int64()), "n": pa.array(n[has]), "total": pa.array(list(total[has]), pa.list_(pa.float64()))})

    parts = points.select("id", "vector").mapInArrow(run, "cluster long, n long, total array<double>")
    sums = parts.select("cluster", "n", F.posexplode("total").alias("axis", "v")).groupBy("cluster", "axis").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    out = centres.copy()
    for r in sums.select("cluster", "axis", (F.col("v") / F.col("n")).alias("m")).collect():  # k times the vector's length
        out[r["cluster"], r["axis"]] = r["m"]
    return out


def seeds(points: DataFrame, k: int, rounds: int, share: float) -> np.ndarray:
    """Seeds of points (id, vector). About ``share`` points are drawn in a round."""
    first = points.orderBy(draw(F.col("id"), 0), "id").limit(1).collect()
    if not first:
        return np.zeros((0, 0))
    found = np.array([first[0]["vector"]], float)
    for r in range(1, rounds + 1):
        near = placed(points, found)
        total = near.agg(F.sum("d2")).first()[0]
        if not total:
            break
        drawn = near.where(draw(F.col("id"), r) < F.lit(share / total) * F.col("d2")).orderBy("id").select("vector").collect()
        if drawn:
            found = np.vstack([found, np.array([x["vector"] for x in drawn], float)])
    weight = np.zeros(len(found), np.int64)
    for x in placed(points, found).groupBy("cluster").count().collect():  # a row a seed
        weight[x["cluster"]] = x["count"]
    return found[np.lexsort((np.arange(len(found)), -weight))[:k]]


def kmeans(df: DataFrame, key: str, vector: str, k: int, passes: int = 5, rounds: int = 3, share: float | None = None) -> tuple[np.ndarray, DataFrame]:
    """The centres, and the points (id, vector, cluster, d2: squared distance to its centre)."""
    kind = df.schema[key].dataType.simpleString()
    points = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast(kind).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    centres = seeds(points, k, rounds, 2.0 * k if share is None else share)
    if not len(centres):
        return centres, points.withColumns({"cluster": F.lit(0).cast("long"), "d2": F.lit(0.0)})
    for _ in range(passes):
        centres = means(points, centres)
    return centres, placed(points, centres)


def representatives(points: DataFrame) -> DataFrame:
    """(cluster, n, id): of each cluster its size and the point nearest to its centre."""
    best = F.min(F.struct("d2", "id"))
    return points.groupBy("cluster").agg(F.count("*").alias("n"), best.getField("id").alias("id"))
