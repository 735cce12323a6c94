"""Places and running sums in an order without a window over very many rows: the order is dealt in
ranges, each task numbers and sums its own rows, and what the ranges before hold is added."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import scratch_dir

#: Rows of a group that one task may sort for a window; beyond that the order is dealt in ranges.
WINDOW_ROWS = 2_000_000


def _dealt(df: DataFrame, order: list) -> DataFrame:
    """``df`` with the range (``_task``) of each row and its place there (``_nth``). The ranges are
    written once, so that all passes over them see the same rows."""
    path = f"{scratch_dir(df.sparkSession)}/order-{uuid.uuid4().hex}"
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # the id's upper bits are the range, its lower 33 bits the row's place there
    ranged.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    return rows.withColumn("_task", F.shiftright("_at", 33)).withColumn("_nth", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")


def global_position(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with its place (from 0) in the order."""
    rows = _dealt(df, order)
    sizes = rows.groupBy("_task").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_task", before.alias("_before"))  # one row a range
    return rows.join(F.broadcast(starts), "_task").withColumn(name, (F.col("_before") + F.col("_nth")).cast("long")).drop("_task", "_nth", "_before")


def running_sum(df: DataFrame, by: list[str], order: list[str], size: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``size`` over the rows before each in its group's order."""
    largest = df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if largest <= WINDOW_ROWS:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long"))
    rows = _dealt(df.withColumn("_size", size), [*by, *order])
    w = Window.partitionBy("_task", *by).orderBy("_nth").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("_size").over(w), F.lit(0))
    # one row for each group that meets a range
    parts = rows.groupBy("_task", *by).agg(F.sum("_size").alias("_n"))
    w = Window.partitionBy(*by).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(F.col("_task").alias("_of"), *[F.col(c).alias(f"_by_{c}") for c in by], F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    same = F.col("_task") == F.col("_of")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    out = rows.withColumn("_inside", inside).join(starts, same)
    return out.withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).select(*df.columns, name)


def group_position(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with its place (from 0) in its group's order."""
    return running_sum(df, by, order, F.lit(1), name)
