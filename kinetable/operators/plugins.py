"""Places where users add their own: examples, evaluators, samplers, preparation and models."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .schedule import endless_place


@dataclass
class Registry:
    """Things by kind and name; a name is given once."""

    items: dict[str, dict[str, object]] = field(default_factory=dict)

    def add(self, kind: str, name: str):
        def put(thing):
            if name in self.items.setdefault(kind, {}):
                raise ValueError(f"{kind} {name} exists")
            self.items[kind][name] = thing
            return thing

        return put

    def get(self, kind: str, name: str):
        try:
            return self.items[kind][name]
        except KeyError:
            raise KeyError(f"no {kind} {name}; there are {sorted(self.items.get(kind, {}))}") from None


@dataclass(frozen=True)
class Evaluator:
    """A metric in three parts, so that it merges over tasks, nodes and runs: expressions of each
    row, which are summed, and the value of the sums."""

    parts: dict[str, str]
    value: Callable[[dict[str, Column]], Column]

    def partial(self, rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.groupBy(*by).agg(*[F.sum(F.expr(c)).alias(n) for n, c in self.parts.items()])

    def merge(self, *partials: DataFrame, by: list[str]) -> DataFrame:
        whole = partials[0]
        for p in partials[1:]:
            whole = whole.unionByName(p)
        return whole.groupBy(*by).agg(*[F.sum(n).alias(n) for n in self.parts])

    def finish(self, sums: DataFrame, by: list[str], name: str) -> DataFrame:
        return sums.select(*by, self.value({n: F.col(n) for n in self.parts}).alias(name))


def examples(rows: DataFrame, key: str, prepare: Callable[[Column, Column], Column], epochs: int, pad_to: int, seed: int = 0) -> DataFrame:
    """(epoch, place, example, valid, weight): every row of each epoch through ``prepare`` (key,
    epoch), and rows that only fill up to a multiple of ``pad_to``; they have no weight."""
    n = rows.count()
    want = -(-n // pad_to) * pad_to
    place = rows.sparkSession.range(epochs * want).select((F.floor(F.col("id") / want)).cast("long").alias("epoch"), (F.col("id") % want).alias("place"))
    own = rows.select(F.col(key).alias("_k"))
    from .ordering import global_position

    numbered = global_position(own, ["_k"], "_row")
    step = next(s for s in (7, 11, 13, 17, 19, 23) if n % s)
    _, row = endless_place(F.col("epoch") * n + F.col("place") % n, n, step, seed + 1)
    j = place.withColumn("_row", row).join(numbered, "_row")
    valid = F.col("place") < n
    return j.select("epoch", "place", prepare(F.col("_k"), F.col("epoch")).alias("example"), valid.alias("valid"), valid.cast("double").alias("weight"))


def collated(df: DataFrame, columns: list[str], collate: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """A collator over Arrow batches, made once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield collate(b)

    return df.select(*columns).mapInArrow(run, schema)


@dataclass(frozen=True)
class FrameSampler:
    """Which frames of a video are taken; a call may ask for other numbers than the sampler's."""

    most: int = 8
    stride: int = 1

    def frames(self, n_frames: Column, most: int | None = None, stride: int | None = None) -> Column:
        k, s = most or self.most, stride or self.stride
        there = F.greatest(F.lit(1), F.ceil(n_frames / s)).cast("int")
        take = F.least(F.lit(k), there)
        # evenly over what is there, the first frame included
        return F.transform(F.sequence(F.lit(0), take - 1), lambda i: (F.floor(i * there / take) * s).cast("long"))
