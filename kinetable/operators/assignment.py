"""Least-cost one-to-one assignment by shortest augmenting paths, with the prices that prove it,
over the frames of a table.

Prices are a certificate: if no pair costs less than the prices of its two sides together, and
taken pairs cost exactly that, and what is left over is free, then no matching costs less. Anyone
can check that by aggregation, without solving anything (``certificate``)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cost of a pair of a frame that isn't listed.
UNLISTED = 1e9


def priced_assignment(cost: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Pairs (row, column) of least total cost, the smaller side matched whole, and the prices of
    rows and columns: their sum never exceeds a pair's cost and equals it for taken pairs; prices
    of the larger side are at most 0, and 0 where nothing is taken."""
    cost = np.asarray(cost, float)
    if cost.size == 0:
        return [], np.zeros(cost.shape[0]), np.zeros(cost.shape[1] if cost.ndim > 1 else 0)
    if cost.shape[0] > cost.shape[1]:
        pairs, v, u = priced_assignment(cost.T)
        return sorted((i, j) for j, i in pairs), u, v
    n, m = cost.shape
    u, v = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for start in range(n):
        dist, back, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        i, reach, col = start, 0.0, -1
        while True:
            slack = reach + cost[i] - u[i] - v
            better = ~done & (slack < dist)
            dist[better], back[better] = slack[better], col
            nxt = int(np.argmin(np.where(done, np.inf, dist)))
            reach, col = dist[nxt], nxt
            if row_of[nxt] < 0:
                break
            done[nxt] = True
            i = row_of[nxt]
        for j in np.flatnonzero(done):
            u[row_of[j]] += reach - dist[j]
            v[j] += dist[j] - reach
        u[start] += reach
        while col >= 0:
            prev = back[col]
            row_of[col] = start if prev < 0 else row_of[prev]
            col = prev
    return sorted((int(i), j) for j, i in enumerate(row_of) if i >= 0), u, v


def best_assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost; the smaller side is matched whole."""
    return priced_assignment(cost)[0]


def assigned(pairs: DataFrame, by: list[str], true_id: str, said_id: str, cost: str) -> DataFrame:
    """One row for each pair of true and said object that a frame (``by``) lists: its least cost,
    whether it is taken, and the prices of its sides. Frames are dealt to tasks one by one and are
    as large as one picture's objects; a pair that isn't listed counts as UNLISTED and is never
    in the result. Rows with a null id or cost are left out."""

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        c = pdf.pivot_table(index="true_id", columns="said_id", values="cost", aggfunc="min")
        at = c.to_numpy()
        taken, u, v = priced_assignment(np.nan_to_num(at, nan=UNLISTED))
        mark = np.zeros(at.shape, bool)
        for i, j in taken:
            mark[i, j] = True
        i, j = np.nonzero(~np.isnan(at))
        out = pd.DataFrame({"true_id": c.index.to_numpy()[i], "said_id": c.columns.to_numpy()[j], "cost": at[i, j], "taken": mark[i, j], "true_price": u[i], "said_price": v[j]})
        for k, name in enumerate(by):
            out.insert(k, name, key[k])
        return out

    kind = lambda c: pairs.schema[c].dataType.simpleString()
    schema = ", ".join([*[f"`{c}` {kind(c)}" for c in by], f"true_id {kind(true_id)}", f"said_id {kind(said_id)}", "cost double, taken boolean, true_price double, said_price double"])
    rows = pairs.select(*by, F.col(true_id).alias("true_id"), F.col(said_id).alias("said_id"), F.col(cost).cast("double").alias("cost"))
    return rows.where("true_id is not null and said_id is not null and cost is not null").groupBy(*by).applyInPandas(solve, schema)


def certificate(rows: DataFrame, by: list[str], within: float = 1e-9) -> DataFrame:
    """Per frame of ``assigned``: objects of either side, taken pairs, their cost, what the prices
    add up to, and whether the prices prove that no matching costs less: ``feasible`` (no pair
    costs less than its prices, and the larger side's aren't above 0), ``tight`` (taken pairs cost
    their prices, untaken objects of the larger side are free). Aggregations only."""
    reduced = F.col("cost") - F.col("true_price") - F.col("said_price")
    found = F.max("taken")
    sides = []
    for side in ("true", "said"):
        one = rows.groupBy(*by, f"{side}_id").agg(F.max(f"{side}_price").alias("price"), found.alias("used"))
        sides.append(
            one.groupBy(*by).agg(F.count("*").alias(f"n_{side}"), F.sum("price").alias(f"sum_{side}"), F.max("price").alias(f"most_{side}"), F.coalesce(F.max(F.when(~F.col("used"), F.abs("price"))), F.lit(0.0)).alias(f"idle_{side}"))
        )
    pairs = rows.groupBy(*by).agg(F.count_if("taken").alias("n_pairs"), F.coalesce(F.sum(F.when(F.col("taken"), F.col("cost"))), F.lit(0.0)).alias("cost"), F.min(reduced).alias("least"), F.coalesce(F.max(F.when(F.col("taken"), F.abs(reduced))), F.lit(0.0)).alias("gap"))
    out = pairs.join(sides[0], by).join(sides[1], by)
    larger = lambda c: F.when(F.col("n_true") > F.col("n_said"), F.col(f"{c}_true")).when(F.col("n_true") < F.col("n_said"), F.col(f"{c}_said")).otherwise(F.lit(0.0))
    whole = F.col("n_pairs") == F.least("n_true", "n_said")
    return out.select(
        *by, "n_true", "n_said", "n_pairs", "cost", (F.col("sum_true") + F.col("sum_said")).alias("price"),
        ((F.col("least") >= -within) & (larger("most") <= within)).alias("feasible"), (whole & (F.col("gap") <= within) & (larger("idle") <= within)).alias("tight"),
    )
