"""Operators on ordered rows: islands, windows of frames, evaluation times, filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import running_sum


def frame_index(df: DataFrame, by: list[str], order: list[str], name: str = "frame") -> DataFrame:
    """Number rows of a track from 0."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))


def islands(df: DataFrame, by: list[str], frame: str, active: Column, min_gap: int, min_length: int) -> DataFrame:
    """Runs of active frames as (begin, end): runs with a gap of fewer than ``min_gap``
    frames are one, and those shorter than ``min_length`` go."""
    w = Window.partitionBy(*by).orderBy(frame)
    runs = df.where(active).withColumn("_g", F.col(frame) - F.row_number().over(w))
    runs = runs.groupBy(*by, "_g").agg(F.min(frame).alias("begin"), F.max(frame).alias("end"))
    w = Window.partitionBy(*by).orderBy("begin")
    far = F.coalesce((F.col("begin") - F.lag("end").over(w) - 1 >= min_gap).cast("int"), F.lit(1))
    runs = runs.withColumn("_far", far).withColumn("_m", F.sum("_far").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, "_m").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("_m").where(F.col("end") - F.col("begin") + 1 >= min_length)


def history_and_future(df: DataFrame, by: list[str], frame: str, value: str, history: int, future: int, stride: int = 1) -> DataFrame:
    """Each row with the values of the last ``history`` frames, the first repeated on the left
    edge, and of the next ``future`` frames, the last repeated on the right edge; of every
    ``stride``-th frame only."""
    w = Window.partitionBy(*by).orderBy(frame)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(value).over(whole), F.last(value).over(whole)
    past = [F.coalesce(F.lag(value, k * stride).over(w), first) for k in range(history - 1, -1, -1)]
    ahead = [F.coalesce(F.lead(value, k * stride).over(w), last) for k in range(1, future + 1)]
    return df.withColumn("history", F.array(*past)).withColumn("future", F.array(*ahead))


def evaluation_times(begin: Column, end: Column, history: int, future: int) -> Column:
    """First, middle and last time at which a history and a future fit, without repeats."""
    first, last = begin + (history - 1), F.greatest(end - future, begin + (history - 1))
    return F.array_distinct(F.array(first, ((first + last) / 2).cast("long"), last))


def start_times(begin: Column, steps: int = 3, stride: int = 3) -> Column:
    """Times that crowd at the start of a clip."""
    return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: begin + i * stride)


def forward_fill(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Nulls take the last value before them."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(w))


def trailing_mean(df: DataFrame, by: list[str], order: list[str], value: str, n: int, name: str) -> DataFrame:
    """Mean of the last n rows."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(n - 1), 0)
    return df.withColumn(name, F.avg(value).over(w))


def prefix_offset(df: DataFrame, by: list[str], order: list[str], size: str, name: str) -> DataFrame:
    """Where a row's items begin when rows are laid end to end."""
    return running_sum(df, by, order, F.col(size), name)


def from_anchor(df: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Values relative to the first one of the group."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn(name, F.col(value) - F.first(value).over(w))


def strided_frames(step: Column, length: int, stride: int, last: Column) -> Column:
    """Frames step-(length-1)*stride .. step, kept within 0 and last."""
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.greatest(F.lit(0), F.least(last, step - (length - 1 - i) * stride)))


def visible_throughout(df: DataFrame, by: list[str], point: str, frame: str, visible: Column, begin: int, end: int) -> DataFrame:
    """Points that are visible in all frames from begin to end; in a group that has none, those
    visible in the last frame. ``fits`` tells whether the group has points of the first kind."""
    rows = df.where(F.col(frame).between(begin, end))
    p = rows.groupBy(*by, point).agg(F.bool_and(visible).alias("_all"), F.bool_or((F.col(frame) == end) & visible).alias("_last"))
    p = p.withColumn("fits", F.bool_or("_all").over(Window.partitionBy(*by)))
    return p.where(F.when(F.col("fits"), F.col("_all")).otherwise(F.col("_last"))).drop("_all", "_last")


def visible_difference(df: DataFrame, by: list[str], order: list[str], value: str, visible: Column, name: str) -> DataFrame:
    """Step from the row before, where both are visible."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumn("_seen", visible).withColumn(name, F.col(value) - F.lag(value).over(w)).withColumn("_both", F.col("_seen") & F.lag("_seen").over(w))
    return out.where("_both").drop("_seen", "_both")


def merged_on_points(df: DataFrame, by: list[str], group: str, point: str, name: str) -> DataFrame:
    """Points of all groups numbered in one sequence: a group's points follow those of the groups
    before it. Offsets are a running sum over sizes of groups, not over rows."""
    sizes = df.groupBy(*by, group).agg((F.max(point) + 1).alias("_n"))
    w = Window.partitionBy(*by).orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_at", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    return df.join(starts, [*by, group]).withColumn(name, (F.col("_at") + F.col(point)).cast("long")).drop("_at")


def gathered(df: DataFrame, by: list[str], grid: str, width: int, rows: list[int], columns: list[int]) -> DataFrame:
    """Values of a flat grid at every pair of two index lists, as (frame, point, v)."""
    pick = [F.struct(F.lit(f).alias("frame"), F.lit(p).alias("point"), F.get(grid, F.lit(f * width + p)).alias("v")) for f in rows for p in columns]
    return df.select(*by, F.inline(F.array(*pick)))


def exported(track: Column, start: Column, with_start: Column) -> Column:
    """A forecast as it is handed on, where asked for with the start before it."""
    return F.when(with_start, F.concat(F.array(start), track)).otherwise(track)
