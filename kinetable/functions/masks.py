"""Masks of runs and of polygons: decoding and tests of points as expressions, compressed run
lengths and filled polygons in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decode_rle(counts: list[int], height: int, width: int) -> np.ndarray:
    """Mask of runs of zeros and ones in turn, down the columns."""
    flat = np.repeat(np.arange(len(counts)) % 2, counts).astype(bool)
    return flat[: height * width].reshape(width, height).T


def point_in_mask(counts: Column, height: Column, width: Column, x: Column, y: Column) -> Column:
    """Whether the pixel nearest to a point is set in a mask of runs down the columns; a point
    outside the picture isn't. The run that holds the pixel is the first whose end is beyond it."""
    counts, height, width, x, y = (F.col(c) if isinstance(c, str) else c for c in (counts, height, width, x, y))
    i, j = F.rint(y).cast("int"), F.rint(x).cast("int")
    ends = F.transform(counts, lambda c, k: F.aggregate(F.slice(counts, 1, k + 1), F.lit(0), lambda a, v: a + v))
    run = F.size(F.filter(ends, lambda e: e <= j * height + i))
    return (i >= 0) & (i < height) & (j >= 0) & (j < width) & (run % 2 == 1) & (run < F.size(counts))


def point_in_polygon(x: Column, y: Column, corners: Column) -> Column:
    """Whether a point lies in a polygon (flat list of x and y), by the even-odd rule."""
    n = F.floor(F.size(corners) / 2).cast("int")
    at = lambda k, d: F.get(corners, ((k % n) * 2 + d).cast("int"))

    def crosses(k: Column) -> Column:
        x1, y1, x2, y2 = at(k, 0), at(k, 1), at(k + 1, 0), at(k + 1, 1)
        return ((y1 > y) != (y2 > y)) & (x < x1 + (y - y1) * F.try_divide(x2 - x1, y2 - y1))

    return F.size(F.filter(F.sequence(F.lit(0), n - 1), crosses)) % 2 == 1


def polygon_mask(corners: Column, height: int, width: int) -> Column:
    """The mask of a polygon, row by row: pixels whose centres lie inside."""
    place = F.sequence(F.lit(0), F.lit(height * width - 1))
    return F.transform(place, lambda k: point_in_polygon(k % width + 0.5, F.floor(k / width) + 0.5, corners).cast("int"))


def point_in_box(x: Column, y: Column, box: Column) -> Column:
    """Whether a point lies in a box [left, top, right, bottom], edges included."""
    return (x >= F.get(box, F.lit(0))) & (y >= F.get(box, F.lit(1))) & (x <= F.get(box, F.lit(2))) & (y <= F.get(box, F.lit(3)))


# -- masks as runs of pixels, in Arrow batches ------------------------------------


def runs_of(mask: np.ndarray) -> np.ndarray:
    """Lengths of the runs of zeros and ones in turn, down the columns, zeros first."""
    flat = mask.T.ravel()
    edge = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, np.int64)
    runs = np.diff(np.r_[edge, len(flat)])
    return np.r_[0, runs] if len(flat) and flat[0] else runs


def compress(counts: np.ndarray) -> str:
    """Run lengths as text: from the fourth on as differences to the one before the last, in groups
    of five bits, least first, a sixth bit saying that more follow, from the character '0' on."""
    counts = np.asarray(counts, np.int64)
    v = counts.copy()
    v[3:] -= counts[1:-2]
    out = []
    for x in v.tolist():
        while True:
            low, x = x & 31, x >> 5
            more = x != (-1 if low & 16 else 0)
            out.append(48 + low + 32 * more)
            if not more:
                break
    return bytes(out).decode()


def expand(code: str) -> np.ndarray:
    """Run lengths from their text."""
    c = np.frombuffer(code.encode(), np.uint8).astype(np.int64) - 48
    if not len(c):
        return c
    if c.min() < 0 or c.max() > 63 or c[-1] & 32:
        raise ValueError("no run lengths")
    begin = np.flatnonzero(np.r_[True, c[:-1] & 32 == 0])
    nth = np.arange(len(c)) - np.repeat(begin, np.diff(np.r_[begin, len(c)]))
    v = np.add.reduceat((c & 31) << (5 * nth), begin)
    last = np.r_[begin[1:], len(c)] - 1
    v -= np.where(c[last] & 16, np.int64(1) << (5 * (nth[last] + 1)), 0)
    for first in (1, 2):  # each is added to the one before the last
        v[first::2] = np.cumsum(v[first::2])
    return v


def fill(parts: list[list[float]], height: int, width: int) -> np.ndarray:
    """The union of polygons (flat lists of x and y): pixels whose centres lie inside one of them
    by the even-odd rule. Row by row: an edge is met where it crosses the row's middle, and what
    lies left of an odd number of crossings is inside; no pixel is compared with an edge."""
    out = np.zeros((height, width), bool)
    for part in parts:
        p = np.asarray(part, float)[: len(part) // 2 * 2].reshape(-1, 2)
        crossings = np.zeros((height, width + 1), np.int64)
        for (x1, y1), (x2, y2) in zip(p, np.roll(p, -1, 0), strict=True):
            i = np.arange(max(0, int(np.ceil(min(y1, y2) - 0.5))), min(height, int(np.ceil(max(y1, y2) - 0.5))))
            if len(i):
                x = x1 + (i + 0.5 - y1) * (x2 - x1) / (y2 - y1)
                crossings[i, np.clip(np.ceil(x - 0.5), 0, width).astype(np.int64)] += 1
        out |= crossings[:, ::-1].cumsum(1)[:, ::-1][:, 1:] % 2 == 1
    return out


def polygon_runs(df: DataFrame, key: str, parts: str, height: str, width: str) -> DataFrame:
    """(key, counts, code, area) of each row's union of polygons (array of flat arrays). A null
    or empty list of parts is an empty mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            masks = [fill(p or [], h, w) for p, h, w in zip(*[c.to_pylist() for c in b.columns[1:]], strict=True)]
            runs = [runs_of(m) for m in masks]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(runs, pa.list_(pa.int64())), pa.array(list(map(compress, runs)), pa.string()), pa.array([int(m.sum()) for m in masks], pa.int64())], ["key", "counts", "code", "area"])

    return df.select(F.col(key).alias("key"), F.col(parts).cast("array<array<double>>"), F.col(height).cast("int"), F.col(width).cast("int")).mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, counts array<long>, code string, area long").withColumnRenamed("key", key)


def expanded(df: DataFrame, key: str, code: str) -> DataFrame:
    """(key, counts, area) of compressed run lengths; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = [None if c is None else expand(c) for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(runs, pa.list_(pa.int64())), pa.array([None if r is None else int(r[1::2].sum()) for r in runs], pa.int64())], ["key", "counts", "area"])

    return df.select(F.col(key).alias("key"), code).mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, counts array<long>, area long").withColumnRenamed("key", key)
