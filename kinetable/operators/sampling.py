"""Deterministic sampling: every choice is a function of a seed and the row's key, so it needs
no order of rows, holds for any number of tasks, and is the same when a task runs again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import global_position, group_position


def key_hash(key: Column, seed: int = 0) -> Column:
    """Multiplicative hash of an integer key to 32 bits, in plain integer arithmetic."""
    return F.pmod((F.pmod(key + seed, F.lit(1 << 31))) * 2654435761, F.lit(1 << 32))


def uniform(key: Column, seed: int = 0) -> Column:
    """A number from 0 (included) to 1 for each key."""
    return key_hash(key, seed) / F.lit(float(1 << 32))


def mixed(key: Column, seed: int = 0) -> Column:
    """A number from 0 (included) to 1 for each key; unlike ``uniform`` those of keys at a fixed
    distance are as good as independent, as noise for several candidates has to be."""
    h = key_hash(key, seed)
    for k in (1, 2):
        h = key_hash(h.bitwiseXOR(F.shiftright(h, 15)), seed + k)
    return h / F.lit(float(1 << 32))


def split(key: Column, share: float, names: tuple[str, str] = ("val", "train"), seed: int = 0) -> Column:
    return F.when(key_hash(key, seed) < int(share * (1 << 32)), names[0]).otherwise(names[1])


def round_robin_pick(df: DataFrame, category: str, order: list[str], n: int) -> DataFrame:
    """n rows, taking the first of every category, then the second of every one, and so on.
    The rank cut before the final order keeps at most n rows of a category."""
    rank = F.row_number().over(Window.partitionBy(category).orderBy(*order))
    return df.withColumn("turn", rank).where(F.col("turn") <= n).orderBy("turn", category).limit(n)


def first_groups(df: DataFrame, by: str, group: str, k: int) -> DataFrame:
    """All rows of the first k groups of each partition. Groups are ranked, not rows: what is
    sorted is one row a group, after a partial aggregation."""
    groups = df.select(by, group).distinct()
    rank = F.row_number().over(Window.partitionBy(by).orderBy(group))
    return df.join(groups.withColumn("_g", rank).where(F.col("_g") <= k).drop("_g"), [by, group], "left_semi")


def entities_with_few_groups(df: DataFrame, entity: str, group: str, most: int) -> DataFrame:
    """Rows of the entities that have at most so many groups."""
    few = df.groupBy(entity).agg(F.count_distinct(group).alias("_n")).where(F.col("_n") <= most)
    return df.join(few.select(entity), entity, "left_semi")


def strided_pick(items: Column, n: int) -> Column:
    """n items at even steps; fewer items than n are repeated in turn."""
    size = F.size(items)
    at = lambda i: F.when(size >= n, F.floor(i * size / n).cast("int")).otherwise(i % size)
    return F.when(size > 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(items, at(i))))


def full_chunks(df: DataFrame, by: str, order: str, size: int) -> DataFrame:
    """Rows in chunks of ``size`` by order; the last, incomplete chunk goes."""
    out = group_position(df, [by], [order], "_p").withColumn("chunk", F.floor(F.col("_p") / size).cast("long")).drop("_p")
    whole = df.groupBy(by).agg(F.floor(F.count("*") / size).alias("_n"))  # one row a group
    return out.join(whole, by).where(F.col("chunk") < F.col("_n")).drop("_n")


def sqrt_mixture(df: DataFrame, source: str) -> DataFrame:
    """Each source's share of a mixture by the square root of its size."""
    counts = df.groupBy(source).agg(F.count("*").alias("n_rows"))
    return counts.withColumn("weight", F.sqrt("n_rows") / F.sum(F.sqrt("n_rows")).over(Window.partitionBy()))


def nested_mixture(df: DataFrame, group: str, source: str, rates: dict[str, float], default: float = 1.0) -> DataFrame:
    """Rates of groups, each shared among its sources by the root of their sizes, then made to
    add up to one. The windows run over counts of sources, not rows."""
    counts = df.groupBy(group, source).agg(F.count("*").alias("n_rows"))
    rate = F.lit(default)
    for k, v in rates.items():
        rate = F.when(F.col(group) == k, F.lit(v)).otherwise(rate)
    raw = rate * F.sqrt("n_rows") / F.sum(F.sqrt("n_rows")).over(Window.partitionBy(group))
    return counts.withColumn("raw", raw).withColumn("rate", F.col("raw") / F.sum("raw").over(Window.partitionBy())).drop("raw")


def shard(df: DataFrame, order: list[str], shards: int, by: list[str] = ()) -> DataFrame:
    """Every shards-th row in order is of one shard; ``by`` parts the order."""
    if not by:
        return global_position(df, order, "_p").withColumn("shard", (F.col("_p") % shards).cast("long")).drop("_p")
    return group_position(df, list(by), order, "_p").withColumn("shard", (F.col("_p") % shards).cast("long")).drop("_p")


def strided_rows(df: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """(by, i, key): n rows of each group at even steps of its order; a group of fewer rows is
    repeated in turn. Rows are found by their place, so no group is held as a list."""
    rows = group_position(df.select(by, key), [by], [key], "_p")
    sizes = df.groupBy(by).agg(F.count("*").alias("_n"))
    i = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    want = sizes.withColumn("i", i).withColumn("_p", F.when(F.col("_n") >= n, F.floor(F.col("i") * F.col("_n") / n).cast("long")).otherwise(F.col("i") % F.col("_n")))
    return want.join(rows, [by, "_p"]).select(by, "i", key)


def equal_parts(df: DataFrame, by: str, order: str, parts: int, name: str) -> DataFrame:
    """Each group's rows in so many parts by order (from 1), the first ones larger by one row where
    they can't be equal."""
    rows = group_position(df, [by], [order], "_p").join(df.groupBy(by).agg(F.count("*").alias("_n")), by)
    small, more = F.floor(F.col("_n") / parts), F.col("_n") % parts
    edge = more * (small + 1)
    part = F.when(F.col("_p") < edge, F.floor(F.col("_p") / (small + 1))).otherwise(more + F.floor((F.col("_p") - edge) / F.greatest(small, F.lit(1))))
    return rows.withColumn(name, part.cast("long") + 1).drop("_p", "_n")


def cdf_pick(df: DataFrame, by: str, order: str, weight: str, share: float) -> DataFrame:
    """For each group the first row at which the running weight reaches a share of the whole."""
    w = Window.partitionBy(by)
    run = F.sum(weight).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    out = df.withColumn("_run", run).withColumn("_all", F.sum(weight).over(w))
    out = out.where(F.col("_run") >= share * F.col("_all"))
    return out.withColumn("_n", F.row_number().over(w.orderBy(order))).where("_n = 1").drop("_run", "_all", "_n")


def top_p(shares: DataFrame, p: float, weight: str, tie: str) -> DataFrame:
    """The largest shares until they pass p; the one that crosses it is kept."""
    w = Window.partitionBy().orderBy(F.desc(weight), tie).rowsBetween(Window.unboundedPreceding, 0)
    return shares.withColumn("_s", F.sum(weight).over(w)).where(F.col("_s") - F.col(weight) < p).drop("_s")


def bucket_plan(df: DataFrame, bucket: str, order: list[str], plan: dict[str, int], strict: bool = False) -> DataFrame:
    """The first n rows of each planned bucket; ``strict``: an error if a bucket has fewer."""
    if strict:
        there = {r[0]: r[1] for r in df.where(F.col(bucket).isin(list(plan))).groupBy(bucket).count().collect()}
        if short := {k: (there.get(k, 0), n) for k, n in plan.items() if there.get(k, 0) < n}:
            raise ValueError(f"buckets with too few rows (there, planned): {short}")
    need = F.lit(0)
    for k, n in plan.items():
        need = F.when(F.col(bucket) == k, n).otherwise(need)
    rank = F.row_number().over(Window.partitionBy(bucket).orderBy(*order))
    return df.withColumn("_n", rank).where(F.col("_n") <= need).drop("_n")


def mixture(df: DataFrame, source: str, kind: str, manual: dict[str, float] | None = None, default: float | None = None) -> DataFrame:
    """Each source's share: ``naive`` by size, ``uniform``, ``sqrt`` by root of size, or
    ``manual`` by given weights (``default`` for sources without one, else an error)."""
    counts = df.groupBy(source).agg(F.count("*").alias("n_rows"))
    if kind == "manual":
        if not manual or min(manual.values()) < 0 or sum(manual.values()) <= 0:
            raise ValueError("manual weights must not be negative, and some must be positive")
        known = F.create_map(*[F.lit(x) for k, v in manual.items() for x in (k, float(v))])
        missing = F.raise_error(F.concat(F.lit("no weight for source "), F.col(source))) if default is None else F.lit(default)
        raw = F.coalesce(F.try_element_at(known, F.col(source)), missing)
    elif kind in ("naive", "uniform", "sqrt"):
        raw = {"naive": F.col("n_rows").cast("double"), "uniform": F.lit(1.0), "sqrt": F.sqrt("n_rows")}[kind]
    else:
        raise ValueError(f"no mixture {kind}")
    counts = counts.withColumn("_raw", raw)
    return counts.withColumn("weight", F.col("_raw") / F.sum("_raw").over(Window.partitionBy())).drop("_raw")


def pick_in_ranges(ranges: DataFrame, by: list[str], begin: str, end: str, u: Column, name: str) -> DataFrame:
    """One place for each group, uniform over the union of its ranges (ends included); ``u`` is
    the group's uniform number."""
    w = Window.partitionBy(*by)
    size = F.col(end) - F.col(begin) + 1
    r = ranges.withColumn("_at", F.coalesce(F.sum(size).over(w.orderBy(begin).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum(size).over(w))
    k = F.floor(u * F.col("_all")).cast("long")
    return r.where((k >= F.col("_at")) & (k < F.col("_at") + size)).select(*by, (F.col(begin) + k - F.col("_at")).cast("long").alias(name))


def split_least(keys: DataFrame, key: str, share: float, seed: int = 0, names: tuple[str, str] = ("val", "train")) -> DataFrame:
    """A split of distinct keys of which the first part has its share, but one key at least. The
    part is a top-k by hash, whose last key is looked up, so no task sorts all keys."""
    n = max(1, int(keys.count() * share))
    last = keys.select(key_hash(F.col(key), seed).alias("h"), key).orderBy("h", key).limit(n).agg(F.max(F.struct("h", key))).first()[0]
    if last is None:
        return keys.select(key, F.lit(names[1]).alias("part"))
    h = key_hash(F.col(key), seed)
    own = (h < last["h"]) | ((h == last["h"]) & (F.col(key) <= last[key]))
    return keys.select(key, F.when(own, names[0]).otherwise(names[1]).alias("part"))


def sample_with_extras(df: DataFrame, by: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each group in an order drawn by hash (``place`` from 0): without replacement
    where there are so many, else all of them and then extras with replacement."""
    w = Window.partitionBy(by)
    rows = df.withColumn("_r", F.row_number().over(w.orderBy(key_hash(F.col(key), seed), key)) - 1).where(F.col("_r") < n)
    sizes = df.groupBy(by).agg(F.count("*").alias("_n"))
    want = sizes.select(by, "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("place"))
    again = key_hash(F.col(by) * 1000 + F.col("place"), seed) % F.col("_n")
    want = want.withColumn("_r", F.when((F.col("_n") >= n) | (F.col("place") < F.col("_n")), F.col("place")).otherwise(again))
    return want.join(rows, [by, "_r"]).select(by, "place", key)


def best_seen_points(df: DataFrame, by: list[str], point: str, history: Column, visible: Column, n: int) -> DataFrame:
    """The n points of each group with the highest score: 10 if visible in all of the history,
    plus the share of later frames in which they are visible; ties go by point."""
    seen = F.coalesce(F.bool_and(F.when(history, visible)), F.lit(False)).cast("int")
    later = F.coalesce(F.avg(F.when(~history, visible.cast("double"))), F.lit(0.0))
    s = df.groupBy(*by, point).agg((10 * seen + later).alias("score"))
    return s.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), point))).where(F.col("_k") <= n).drop("_k")
