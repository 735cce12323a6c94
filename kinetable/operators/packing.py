"""Packing and padding of examples for training."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import running_sum


#: Rows of a shard.
SHARD_ROWS = 50_000


def pad(items: Column, length: int, value) -> Column:
    """The first ``length`` items, filled up with a value."""
    head = F.slice(items, 1, length)
    return F.concat(head, F.array_repeat(F.lit(value), F.greatest(F.lit(0), length - F.size(head))))


def segments(df: DataFrame, by: list[str], order: list[str], size: str, capacity: int) -> DataFrame:
    """Rows laid end to end and cut into bins of ``capacity``: bin, offset of the row's start in
    its bin, position in the bin."""
    out = running_sum(df, by, order, F.col(size), "_at")
    out = out.withColumn("bin", F.floor(F.col("_at") / capacity).cast("long")).withColumn("offset", (F.col("_at") % capacity).cast("long"))
    return out.withColumn("position", (F.row_number().over(Window.partitionBy(*by, "bin").orderBy(*order)) - 1).cast("long")).drop("_at")


@dataclass(frozen=True)
class Limit:
    """A limit on a size of what is packed together: its most, what a unit is worth to the
    solver, the units in which the solver counts (sizes are rounded up to it), and whether an item
    that reaches the limit alone leaves at once."""

    most: int
    worth: float = 1.0
    step: int = 1
    alone: bool = False

    def units(self, size: int) -> int:
        return -(-size // self.step)

    def room(self) -> int:
        return self.most // self.step


def best_choice(items: list[tuple[int, int]], limits: tuple[Limit, Limit]) -> list[int]:
    """Indices of the items that are worth most together under both limits (0/1 knapsack); of
    equal choices the one without later items. For each pair of sums the best way there is kept,
    with a bit for each item of it: later items replace it only if that is worth more."""
    room = limits[0].room(), limits[1].room()
    worth = np.full((room[0] + 1, room[1] + 1), -1.0)
    chosen = np.zeros(worth.shape, np.uint64 if len(items) <= 64 else object)
    worth[0, 0] = 0.0
    for i, (x, y) in enumerate(items):
        a, b, own = limits[0].units(x), limits[1].units(y), limits[0].worth * x + limits[1].worth * y
        if a > room[0] or b > room[1]:
            continue
        before, bits = worth[: room[0] + 1 - a, : room[1] + 1 - b].copy(), chosen[: room[0] + 1 - a, : room[1] + 1 - b].copy()
        better = (before >= 0) & (before + own > worth[a:, b:])
        worth[a:, b:][better] = (before + own)[better]
        chosen[a:, b:][better] = bits[better] | (np.uint64(1 << i) if len(items) <= 64 else 1 << i)
    best = int(min(chosen[worth == worth.max()]))
    return [i for i in range(len(items)) if best >> i & 1]


def best_subset(sizes: list[tuple[int, int]], limits: tuple[int, int], step: int = 1) -> list[int]:
    """Indices of the items whose first sizes fill the first limit best while the second ones fit."""
    return best_choice(sizes, (Limit(limits[0], 1.0, step), Limit(limits[1], 0.0)))


class BufferedPacker:
    """Holds up to ``buffer`` items. When one more comes, the best choice of what is held leaves
    as one bin and the new item takes its place; an item that fits no bin, or that a limit lets go
    alone, is a bin of its own."""

    def __init__(self, limits: tuple[Limit, Limit], buffer: int, held: list | None = None):
        self.limits, self.buffer, self.held = limits, buffer, list(held or [])

    def add(self, key, a: int, b: int) -> list | None:
        """A bin, if one is due."""
        for limit, size in zip(self.limits, (a, b), strict=True):
            if limit.units(size) > limit.room() or limit.alone and limit.units(size) == limit.room():
                return [(key, a, b)]
        out = self.take() if len(self.held) >= self.buffer else None
        self.held.append((key, a, b))
        return out

    def take(self) -> list:
        """The best bin of what is held; never empty while something is held."""
        chosen = best_choice([x[1:] for x in self.held], self.limits) or [0]
        out = [self.held[i] for i in chosen]
        self.held = [x for i, x in enumerate(self.held) if i not in set(chosen)]
        return out


def as_limits(limits: tuple) -> tuple[Limit, Limit]:
    """Limits from two numbers: the first fills up, in steps of 64, the second only has to hold."""
    if isinstance(limits[0], Limit):
        return limits
    return Limit(limits[0], 1.0, 64), Limit(limits[1], 0.0)


def knapsack_pack(df: DataFrame, key: str, first: str, second: str, limits: tuple, buffer: int = 48, shards: int | None = None) -> DataFrame:
    """Bins of rows under two limits. Rows are dealt to shards by their key and packed there
    in key order, streaming through a bounded buffer, so that the result is the same each
    time and no task holds more than the buffer. Shards grow with the rows."""
    shards, limits = shards or max(8, -(-df.count() // SHARD_ROWS)), as_limits(limits)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packers: dict[int, tuple[BufferedPacker, list[int]]] = {}

        def rows(shard: int, items: list) -> list[tuple]:
            n = packers[shard][1]
            n[0] += 1
            return [(k, a, b, shard, n[0] - 1, i) for i, (k, a, b) in enumerate(items)]

        for f in frames:
            out = []
            for k, a, b, shard in zip(*[f[c].tolist() for c in ("key", "a", "b", "shard")], strict=True):
                p, _ = packers.setdefault(shard, (BufferedPacker(limits, buffer), [0]))
                if (items := p.add(k, a, b)) is not None:
                    out += rows(shard, items)
            yield pd.DataFrame(out, columns=["key", "a", "b", "shard", "bin", "place"])
        out = []
        for shard, (p, _) in packers.items():
            while p.held:
                out += rows(shard, p.take())
        yield pd.DataFrame(out, columns=["key", "a", "b", "shard", "bin", "place"])

    dealt = df.select(F.col(key).cast("long").alias("key"), F.col(first).cast("long").alias("a"), F.col(second).cast("long").alias("b")).withColumn("shard", F.pmod("key", F.lit(shards)))
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "key")
    return dealt.mapInPandas(run, "key long, a long, b long, shard long, bin long, place long")


def balanced_boundaries(counts: list[int], ranks: int) -> list[int]:
    """How many items each rank takes so that their counts are as even as contiguous runs allow.
    A rank's run ends with the first item that brings the sum to its goal; then a rank that has
    nothing takes the next rank's first item, or, if the next has just one, the last item of the
    nearest rank before it that can spare one, and the runs between move along."""
    cum = np.r_[0, np.cumsum(counts)]
    goal = cum[-1] * np.arange(1, ranks + 1) / ranks
    ends = np.searchsorted(cum, goal - 1e-9)
    ends[-1] = len(counts)
    return spread_out(np.diff(np.r_[0, np.maximum.accumulate(ends)]).tolist())


def spread_out(n_items: list[int]) -> list[int]:
    """The repair of ``balanced_boundaries``: no rank stays empty while there are as many items as
    ranks. Items stay in order, so taking one from a rank further off moves all runs between."""
    n = list(n_items)
    for k in range(len(n)):
        if n[k]:
            continue
        if k + 1 < len(n) and n[k + 1] > 1:
            donor = k + 1
        else:
            donor = next((d for d in range(k - 1, -1, -1) if n[d] > 1), next((d for d in range(k + 1, len(n)) if n[d] > 1), None))
        if donor is not None:
            n[donor] -= 1
            n[k] += 1
    return n


def zigzag_chunk(position: Column, length: int, ranks: int) -> Column:
    """Rank of a token when a sequence is cut into 2*ranks chunks and rank k has the k-th from
    either end."""
    chunk = F.floor(position * (2 * ranks) / length).cast("long")
    return F.least(chunk, (2 * ranks - 1) - chunk)


#: Distance between the segment numbers of two examples of a pack (fixed value).
SEGMENT = 100_000


def concatenated(df: DataFrame, by: list[str], nth: str, tokens: str) -> DataFrame:
    """Examples of a pack laid end to end: tokens, segment_ids (SEGMENT times the example's number
    plus the place) and position_ids (the place in the example)."""
    place = F.transform(tokens, lambda v, i: i.cast("long"))
    x = df.select(*by, nth, tokens, place.alias("_p"), F.transform(place, lambda i: F.col(nth) * SEGMENT + i).alias("_s"))
    x = x.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(nth, tokens, "_s", "_p"))).alias("_x"))
    flat = lambda c: F.flatten(F.transform("_x", lambda v: v[c]))
    return x.select(*by, flat(tokens).alias("tokens"), flat("_s").alias("segment_ids"), flat("_p").alias("position_ids"))


def offset_ids(df: DataFrame, by: list[str], nth: str, ids: str, size: str) -> DataFrame:
    """Arrays of indices laid end to end, each moved by the sizes before it; -1 stays."""
    w = Window.partitionBy(*by).orderBy(nth).rowsBetween(Window.unboundedPreceding, -1)
    x = df.withColumn("_at", F.coalesce(F.sum(size).over(w), F.lit(0)))
    moved = F.transform(ids, lambda i: F.when(i < 0, F.lit(-1)).otherwise(i + F.col("_at")))
    x = x.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(nth, moved.alias("m")))).alias("_x"))
    return x.select(*by, F.flatten(F.transform("_x", lambda v: v["m"])).alias(ids))


def balanced_split(items: DataFrame, by: list[str], order: str, count: str, ranks: int) -> DataFrame:
    """(by, rank, first, n_items, n_counted): for each pack (``by``) contiguous runs of its items,
    whose counts are as even as they can be and of which none is empty unless there are fewer
    items than ranks. A pack's items are those of one training example; packs are dealt to tasks."""

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        counts = pdf.sort_values("_order")["_count"].to_numpy()
        n = balanced_boundaries(counts.tolist(), ranks)
        first = np.r_[0, np.cumsum(n)]
        cum = np.r_[0, np.cumsum(counts)]
        out = pd.DataFrame({"rank": np.arange(ranks), "first": first[:-1], "n_items": n, "n_counted": cum[first[1:]] - cum[first[:-1]]})
        for k, name in enumerate(by):
            out.insert(k, name, key[k])
        return out

    kinds = "".join(f"`{c}` {items.schema[c].dataType.simpleString()}, " for c in by)
    rows = items.select(*by, F.col(order).alias("_order"), F.col(count).cast("long").alias("_count"))
    return rows.groupBy(*by).applyInPandas(solve, f"{kinds}rank long, first long, n_items long, n_counted long")


def fullest(df: DataFrame, by: str, key: str, size: str, limits: tuple[int, int]) -> DataFrame:
    """(by, best): the most that a choice of each group's rows fills under a limit on the sum and
    one on the number of rows. Groups are small by their key."""

    def solve(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = [(int(a), 1) for a in pdf.sort_values(key)[size] if a <= limits[0]]
        best: dict[int, set[int]] = {0: {0}}  # sums by number of rows
        for a, _ in own:
            for n in sorted(best, reverse=True):
                if n < limits[1]:
                    best.setdefault(n + 1, set()).update(t + a for t in best[n] if t + a <= limits[0])
        return pd.DataFrame([(group[0], max(max(s) for s in best.values() if s))])

    return df.select(by, key, size).groupBy(by).applyInPandas(solve, f"{by} long, best long")
