"""Text tokens and pictures' tokens in one sequence, with the index of the patches that each picture
token pools.

A picture is a grid of patches. Rectangles of ``pool`` patches become a token; a grid that doesn't
divide is padded on both sides (of an odd number the end gets more), padding being -1. A picture
stands as a start mark, its tokens row by row with a mark after each row, and an end mark. It takes
the place of the picture mark in the text, or, if the text has none, follows the first token.
Patches are counted on over the pictures of an example."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rows whose tokens a task has as values at once; an Arrow batch may hold 10,000.
FEW = 64


@dataclass(frozen=True)
class Marks:
    """Ids of the picture's place in a text, and of the tokens that a picture is made of."""

    picture: int = -1
    start: int = -2
    patch: int = -3
    row: int = -4
    end: int = -5


def pooled(height: int, width: int, pool: tuple[int, int]) -> np.ndarray:
    """A row for each token of a grid: the patches that it pools, -1 for padding."""
    (ph, pw), index = pool, np.arange(height * width).reshape(height, width)
    over = -height % ph, -width % pw
    index = np.pad(index, [(n // 2, (n + 1) // 2) for n in over], constant_values=-1)
    rows, columns = index.shape[0] // ph, index.shape[1] // pw
    return index.reshape(rows, ph, columns, pw).transpose(0, 2, 1, 3).reshape(rows * columns, ph * pw)


def picture_tokens(height: int, width: int, pool: tuple[int, int], marks: Marks) -> np.ndarray:
    rows, columns = -(-height // pool[0]), -(-width // pool[1])
    body = np.tile(np.r_[np.full(columns, marks.patch), marks.row], rows)
    return np.r_[marks.start, body, marks.end].astype(np.int64)


def sequence(ids: np.ndarray, loss: np.ndarray, grids: list[tuple[int, int]], pool: tuple[int, int], marks: Marks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, losses and pooled patches of one example."""
    places = np.flatnonzero(ids == marks.picture)
    if not len(places):
        places, keep = np.full(len(grids), min(1, len(ids))), np.ones(len(ids), bool)
    else:
        keep = ids != marks.picture
    if len(places) != len(grids):
        raise ValueError(f"{len(places)} marks of {len(grids)} pictures")
    tokens = [picture_tokens(h, w, pool, marks) for h, w in grids]
    at = np.repeat(places, [len(t) for t in tokens]) if tokens else np.zeros(0, np.int64)
    kept = np.flatnonzero(keep)
    where = np.r_[at * 2, kept * 2 + 1]  # a picture comes before the text token at its place
    order = np.argsort(where, kind="stable")
    every = np.concatenate([*tokens, ids[kept]])[order]
    losses = np.r_[np.zeros(len(at), loss.dtype), loss[kept]][order]
    before = np.cumsum([0, *[h * w for h, w in grids]])
    index = [np.where((p := pooled(h, w, pool)) >= 0, p + n, -1) for (h, w), n in zip(grids, before[:-1], strict=True)]
    return every, losses, np.concatenate(index) if index else np.zeros((0, pool[0] * pool[1]), np.int64)


def interleaved(df: DataFrame, key: str, ids: str, loss: str, grids: str, pool: tuple[int, int] = (2, 2), marks: Marks = Marks()) -> DataFrame:
    """Per row: input and target tokens (the next ones), the targets' losses, positions and pooled
    patches. ``grids``: array of structs of height and width, in patches; null is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, numbers = pa.list_(pa.int64()), lambda v: v.values.to_numpy(zero_copy_only=False) if v.is_valid else np.zeros(0, np.int64)
        for whole in batches:
            for k in range(0, whole.num_rows, FEW):
                b, out = whole.slice(k, FEW), []
                for i, x, g in zip(b.column(1), b.column(2), b.column(3).to_pylist(), strict=True):
                    t, loss_, index = sequence(numbers(i), numbers(x), [tuple(v.values()) for v in g or []], pool, marks)
                    out.append((t[:-1], t[1:], loss_[1:], np.arange(max(0, len(t) - 1)), index))
                cols = [pa.array(c, flat) for c in list(zip(*out, strict=True))[:4]]
                each = pa.ListArray.from_arrays(np.cumsum([0, *[n for o in out for n in [o[4].shape[1]] * len(o[4])]]).astype(np.int32), pa.array(np.concatenate([o[4].ravel() for o in out]).astype(np.int64)))
                cols.append(pa.ListArray.from_arrays(np.cumsum([0, *[len(o[4]) for o in out]]).astype(np.int32), each))
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["key", "input_tokens", "target_tokens", "loss_masks", "position_ids", "pooled"])

    x = df.select(F.col(key).alias("key"), F.col(ids).cast("array<long>"), F.col(loss).cast("array<long>"), grids)
    schema = f"key {df.schema[key].dataType.simpleString()}, input_tokens array<long>, target_tokens array<long>, loss_masks array<long>, position_ids array<long>, pooled array<array<long>>"
    return x.mapInArrow(run, schema).withColumnRenamed("key", key)
