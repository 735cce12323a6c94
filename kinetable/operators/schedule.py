"""The order in which a mixture of datasets feeds training, as a table.

A schedule is a function of the seed, so every worker that reads a part of it agrees with all
others without talking to them, and a restart goes on at any position."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import scratch_dir
from .ordering import global_position, group_position
from .sampling import key_hash, uniform


def epoch_order(df: DataFrame, key: str, epochs: int, seed: int) -> DataFrame:
    """Every row once in each epoch, in an order drawn for the epoch (``place`` from 0)."""
    n = df.count()
    e = df.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(epochs - 1).cast("long"))))
    e = e.withColumn("_h", key_hash(F.col(key) * 31 + F.col("epoch") * 7919, seed))
    placed = global_position(e, ["epoch", "_h", key], "place")
    return placed.withColumn("place", F.col("place") - F.col("epoch") * n).drop("_h")


def endless_place(position: Column, n: int, step: int, shift: int) -> tuple[Column, Column]:
    """Epoch and row of any position of an endless stream over n rows: in each epoch an affine
    permutation, so that no order is kept anywhere (``step`` must be prime to n)."""
    if math.gcd(step, n) != 1:
        raise ValueError(f"{step} and {n} have a common divisor")
    epoch = F.floor(position / n).cast("long")
    return epoch, F.pmod((position % n) * step + (epoch + 1) * shift, F.lit(n))


def multinomial_draws(spark: SparkSession, rates: dict[str, float], n: int, seed: int) -> DataFrame:
    """Draw i of n is of source s with the source's rate; no draw depends on another."""
    total, run, pick = sum(rates.values()), 0.0, F.lit(None).cast("string")
    u = uniform(F.col("position"), seed) * total
    edges = []
    for s, r in sorted(rates.items()):
        run += r
        edges.append((run, s))
    for edge, s in reversed(edges):
        pick = F.when(u < edge, s).otherwise(pick)
    df = spark.range(n).withColumnRenamed("id", "position").withColumn("source", F.coalesce(pick, F.lit(edges[-1][1])))
    return group_position(df, ["source"], ["position"], "nth")


def stratified_draws(spark: SparkSession, rates: dict[str, float], n: int) -> DataFrame:
    """Each draw is of the source that lags its rate most. The k-th draw of a source is due at
    (k + 1/2) / rate, so the order is a sort by due times, not a loop over draws."""
    total = sum(rates.values())
    rows = [(s, r / total) for s, r in sorted(rates.items()) if r > 0]
    src = spark.createDataFrame(rows, "source string, rate double")
    src = src.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.lit(n) * F.col("rate")).cast("long"))))
    due = global_position(src.withColumn("due", (F.col("nth") + 0.5) / F.col("rate")), ["due", "source"], "position")
    return due.where(F.col("position") < n).select("position", "source", "nth")


def owner(position: Column, ranks: int, workers: int, batch: int) -> tuple[Column, Column]:
    """Rank and worker of a position: ranks take turns by batch, a rank's workers by example."""
    block = F.floor(position / batch).cast("long")
    return block % ranks, F.floor(block / ranks).cast("long") % workers


def weighted_choice(df: DataFrame, by: list[str], order: str, weight: str, u: Column) -> DataFrame:
    """One row for each group, with a probability in proportion to its weight; ``u`` is the
    group's uniform number."""
    w = Window.partitionBy(*by)
    run = F.sum(weight).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    out = df.withColumn("_run", run).withColumn("_all", F.sum(weight).over(w)).where(F.col(weight) > 0)
    out = out.where(F.col("_run") > u * F.col("_all"))
    return out.withColumn("_n", F.row_number().over(w.orderBy(order))).where("_n = 1").drop("_run", "_all", "_n")


def rollout(start: DataFrame, step, rounds: int, keep: int, history: int) -> DataFrame:
    """Forecast in rounds: ``step`` maps (key, history array) to (key, future array); the first
    ``keep`` values are kept and the last ``history`` of what is known start the next round.
    Rounds are few; each is one more stage of the same lazy plan."""
    state = start.select("key", "history", F.array().cast("array<double>").alias("kept"))
    for _ in range(rounds):
        nxt = step(state.select("key", "history")).select("key", F.slice("future", 1, keep).alias("new"))
        state = state.join(nxt, "key")
        known = F.concat("history", "new")
        state = state.select("key", F.slice(known, F.size(known) - history + 1, F.lit(history)).alias("history"), F.concat("kept", "new").alias("kept"))
    return state.select("key", "kept")


def descendants(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node) for every node at or below a root of a tree given as (parent, child). Each
    round follows paths twice as long as the last, so rounds grow with the logarithm of the
    depth, and no depth is too great; an edge that closes a ring ends nothing and adds nothing."""
    spark = edges.sparkSession
    keep = lambda df: _written(spark, df)
    paths = keep(edges.select(F.col("parent").alias("a"), F.col("child").alias("b")).distinct())
    found = keep(roots.select("root", F.col("root").alias("node")).distinct())
    while True:
        n = found.count()
        more = found.join(paths, found["node"] == paths["a"]).select("root", F.col("b").alias("node"))
        found = keep(found.union(more).distinct())
        if found.count() == n:
            return found
        twice = paths.join(paths.toDF("b", "c"), "b").select("a", F.col("c").alias("b"))
        paths = keep(paths.union(twice).distinct())


def _written(spark: SparkSession, df: DataFrame) -> DataFrame:
    path = f"{scratch_dir(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def resample(df: DataFrame, by: list[str], at: str, value: str, grid: DataFrame, target: str) -> DataFrame:
    """Values at the times of ``grid`` (by, target) by straight lines between neighbours; beyond
    the ends the end values hold."""
    w = Window.partitionBy(*by).orderBy(at)
    seg = df.select(*by, F.col(at).alias("_t"), F.col(value).alias("_v"), F.lead(at).over(w).alias("_t2"), F.lead(value).over(w).alias("_v2"), F.lag(at).over(w).isNull().alias("_first"))
    j = grid.join(seg, by).where(((F.col(target) >= F.col("_t")) & (F.col("_t2").isNull() | (F.col(target) < F.col("_t2")))) | (F.col("_first") & (F.col(target) < F.col("_t"))))
    share = F.try_divide(F.col(target) - F.col("_t"), F.col("_t2") - F.col("_t"))
    inside = F.col("_t2").isNotNull() & (F.col(target) >= F.col("_t"))
    return j.select(*by, target, F.when(inside, F.col("_v") + share * (F.col("_v2") - F.col("_v"))).otherwise(F.col("_v")).alias(value))


def predict(df: DataFrame, model, columns: list[str], schema: str) -> DataFrame:
    """Run a model over Arrow-backed frames; ``model`` is made once for each task and called with
    a frame of ``columns`` for each batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = model()
        for f in frames:
            yield call(f)

    return df.select(*columns).mapInPandas(run, schema)
