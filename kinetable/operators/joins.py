"""Joins that need more than equal keys: as-of, nearest in time, interval overlap, membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, value: str, name: str) -> DataFrame:
    """Each left row with the last right row (``value`` as ``name``) at or before its time.

    Both sides are laid in one sequence for each key and a running maximum carries the last
    right row along: one shuffle on the keys and one sort, where an inequality join would
    compare all pairs of a key. The greatest value wins among right rows of one time.
    """
    cols = left.columns
    mark = F.struct(F.col(on).alias("t"), F.col(value).alias("v"))
    a = left.withColumn("_m", F.lit(None).cast(_struct_type(right, on, value)))
    b = right.select(*by, on, mark.alias("_m"))
    both = a.withColumn("_l", F.lit(True)).unionByName(b.withColumn("_l", F.lit(False)), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(on).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("_m", F.max("_m").over(w)).where("_l").select(*cols, F.col("_m.v").alias(name))


def _struct_type(df: DataFrame, on: str, value: str) -> str:
    return f"struct<t:{df.schema[on].dataType.simpleString()},v:{df.schema[value].dataType.simpleString()}>"


def nearest_join(left: DataFrame, right: DataFrame, by: list[str], on: str, key: str, value: str, within: float) -> DataFrame:
    """Each left row with the nearest right row not farther than ``within`` (numbers).

    Times are cut into buckets as wide as the range, and a left row meets the right rows of
    three buckets by equality, so the join is a hash join. The smaller ``value`` wins a tie.
    ``key`` identifies left rows; those without a match are kept with nulls.
    """
    bucket = F.floor(F.col(on) / within).cast("long")
    a = left.withColumn("_b", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    b = right.select(*by, bucket.alias("_b"), F.col(on).alias("_t"), F.col(value).alias("_v"))
    near = a.join(b, [*by, "_b"]).where(F.abs(F.col(on) - F.col("_t")) <= within)
    best = near.groupBy(key).agg(F.min(F.struct(F.abs(F.col(on) - F.col("_t")).alias("gap"), F.col("_v").alias("v"))).alias("_m"))
    return left.join(best, key, "left").select(*left.columns, F.col("_m.v").alias(f"near_{value}"), F.col("_m.gap").alias("gap"))


def overlapping(spans: DataFrame, times: DataFrame, by: list[str], begin: str, end: str, at: str) -> DataFrame:
    """Spans during which a time of the same key falls (semi join): the first time at or
    after the span's begin decides, found as in asof_join."""
    t = times.select(*by, F.col(at).alias("_t")).distinct()
    s = spans.withColumn("_t", F.col(begin)).withColumn("_s", F.lit(True))
    both = s.unionByName(t.withColumn("_s", F.lit(False)), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("_t").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    next_ = F.min(F.when(~F.col("_s"), F.col("_t"))).over(w)
    return both.withColumn("_n", next_).where(F.col("_s") & (F.col("_n") <= F.col(end))).select(*spans.columns)


def member_flag(df: DataFrame, keys: DataFrame, on: list[str], name: str) -> DataFrame:
    """``df`` with a flag that tells whether the row's key is among ``keys``."""
    return df.join(keys.select(*on).distinct().withColumn(name, F.lit(True)), on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def without_done(work: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Work that isn't done yet (resume)."""
    return work.join(done.select(*on).distinct(), on, "left_anti")


def keep_listed_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is listed (semi join)."""
    return df.join(keys.select(*on), on, "left_semi")


def last_of_duplicates(df: DataFrame, key: list[str], order: Column) -> DataFrame:
    """One row for each key: the last in order, as a lookup table built row by row has."""
    w = Window.partitionBy(*key).orderBy(order.desc())
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def strict_join(left: DataFrame, right: DataFrame, on: list[str], value: str) -> DataFrame:
    """Inner join that fails, with the key in its message, if a left row has no match."""
    key = F.to_json(F.struct(*on))
    hit = left.join(right.withColumn("_hit", F.lit(True)), on, "left")
    checked = F.when(F.col("_hit"), F.col(value)).otherwise(F.raise_error(F.concat(F.lit("no match for "), key)))
    return hit.withColumn(value, checked).drop("_hit")


def exact_or_positional(left: DataFrame, right: DataFrame, by: list[str], exact: str, position: str, value: str) -> DataFrame:
    """Left rows with the right ``value`` (as mask_id) of the same exact key, the least if there
    are several, else of the same position; ``exact`` tells which."""
    same = right.groupBy(*by, exact).agg(F.min(value).alias("_exact"))
    nth = right.select(*by, position, F.col(value).alias("_nth"))
    out = left.join(same, [*by, exact], "left").join(nth, [*by, position], "left")
    return out.select(*left.columns, F.coalesce("_exact", "_nth").alias("mask_id"), F.col("_exact").isNotNull().alias("exact"))


def sliced(spans: DataFrame, frames: DataFrame, by: list[str], begin: str, end: str, frame: str) -> DataFrame:
    """Frames begin to end (included) of each span, counted from its begin: a span names its
    frames, so the join is on equal keys."""
    want = spans.withColumn(frame, F.explode(F.sequence(F.col(begin), F.col(end))))
    return want.join(frames, [*by, frame]).withColumn(frame, F.col(frame) - F.col(begin))


def lines_in_view(lines: DataFrame, times: DataFrame, by: list[str], begin: str, end: str, at: str, slack: float) -> DataFrame:
    """Lines (spans in seconds) during which, give or take ``slack``, a time falls."""
    wide = lines.withColumn("_a", F.col(begin) - slack).withColumn("_b", F.col(end) + slack)
    return overlapping(wide, times, by, "_a", "_b", at).select(*lines.columns)
