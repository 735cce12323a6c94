"""Forecast and tracking metrics as aggregations over long tables (one row a point and frame)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .assignment import assigned, best_assignment


def threshold_rate(err: Column, thresholds: list[float]) -> Column:
    """Mean over thresholds of whether the error is within."""
    return sum(((err <= t).cast("double") for t in thresholds), F.lit(0.0)) / float(len(thresholds))


def trajectory_scores(err: DataFrame, point: list[str], frame: str, error: str, clip: list[str], thresholds: list[float], by: list[str] = ()) -> DataFrame:
    """Mean error over all rows (ADE), over each point's last row (FDE), the threshold rate
    (PWT), and the number of clips. Rows without an error don't count; nothing at all gives 0.
    A point is summed up where its rows lie, so no rows are sorted and one row a point moves."""
    key = list(dict.fromkeys([*by, *clip, *point]))
    points = err.where(F.col(error).isNotNull()).groupBy(*key).agg(
        F.sum(error).alias("_sum"), F.count("*").alias("_n"), F.max_by(error, frame).alias("_last"), F.sum(threshold_rate(F.col(error), thresholds)).alias("_rate")
    )
    zero, n = F.lit(0.0), F.sum("_n")
    return points.groupBy(*by).agg(
        F.coalesce(F.try_divide(F.sum("_sum"), n), zero).alias("ade"),
        F.coalesce(F.avg("_last"), zero).alias("fde"),
        F.coalesce(F.try_divide(F.sum("_rate"), n), zero).alias("pwt"),
        F.count_distinct(*clip).alias("n_clips"),
    )


def rollup_weighted(df: DataFrame, item: list[str], group: str, value: str, weight: str) -> DataFrame:
    """Weighted mean of each item, then plain means over items, of each group and of all."""
    items = df.groupBy(*item, group).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("m"))
    return items.groupingSets([[group], []], group).agg(F.avg("m").alias("mean_value"), F.count("*").alias("n_items"))


def trimmed_mean(df: DataFrame, by: list[str], value: str, share: float = 0.8, least: int = 5) -> DataFrame:
    """Mean of each group without what is above its percentile, which groups of fewer than
    ``least`` values keep; groups without a value have 0."""
    cut = df.groupBy(*by).agg(F.percentile(value, share).alias("_p"), F.count(value).alias("_n"))
    kept = (F.col("_n") < least) | (F.col(value) <= F.col("_p"))
    return df.join(cut, by).groupBy(*by).agg(F.coalesce(F.avg(F.when(kept, F.col(value))), F.lit(0.0)).alias("trimmed"))


def tapvid(df: DataFrame, error: str, true_occluded: str, said_occluded: str, evaluated: Column, by: list[str], thresholds: tuple[int, ...] = (1, 2, 4, 8, 16)) -> DataFrame:
    """Occlusion accuracy, and for each threshold the share of visible points within it and the
    Jaccard index of points found. A count of nothing gives null."""
    rows, seen, said = df.where(evaluated), ~F.col(true_occluded), ~F.col(said_occluded)
    share = lambda a, b: F.try_divide(F.count_if(a).cast("double"), F.count_if(b))
    out = [F.avg((F.col(true_occluded) == F.col(said_occluded)).cast("double")).alias("occlusion_accuracy")]
    for t in thresholds:
        near = F.col(error) < t
        good = F.count_if(seen & said & near)
        wrong = F.count_if(seen) + F.count_if(said & (~seen | ~near))
        out += [share(seen & near, seen).alias(f"within_{t}"), F.try_divide(good.cast("double"), wrong).alias(f"jaccard_{t}")]
    res = rows.groupBy(*by).agg(*out)
    mean = lambda p: sum((F.col(f"{p}_{t}") for t in thresholds), F.lit(0.0)) / float(len(thresholds))
    return res.withColumn("within_average", mean("within")).withColumn("jaccard_average", mean("jaccard"))


def precision_recall(df: DataFrame, said: Column, true: Column, by: list[str] = ()) -> DataFrame:
    """Precision, recall and F1; without anything said (or true) precision (or recall) is 1 if
    there was nothing to find (or say), else 0."""
    hit, n_said, n_true = F.count_if(said & true), F.count_if(said), F.count_if(true)
    out = df.groupBy(*by).agg(hit.alias("hit"), n_said.alias("n_said"), n_true.alias("n_true"))
    p = F.when(F.col("n_said") > 0, F.try_divide(F.col("hit").cast("double"), "n_said")).otherwise((F.col("n_true") == 0).cast("double"))
    r = F.when(F.col("n_true") > 0, F.try_divide(F.col("hit").cast("double"), "n_true")).otherwise((F.col("n_said") == 0).cast("double"))
    out = out.withColumn("precision", p).withColumn("recall", r)
    return out.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-10))


def weighted_mean(value: str, weight: str) -> Column:
    return F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight))


def extremes(df: DataFrame, by: str, key: str, least: bool = False) -> DataFrame:
    """All keys of the largest (or least) count in each group, ties included."""
    counts = df.groupBy(by, key).agg(F.count("*").alias("n_rows"))
    order = F.col("n_rows") if least else F.col("n_rows").desc()
    return counts.withColumn("_r", F.rank().over(Window.partitionBy(by).orderBy(order))).where("_r = 1").drop("_r")


#: Similarities at which tracks are matched (fixed values).
ALPHAS = [round(0.05 * k, 2) for k in range(1, 20)]


def hota(pairs: DataFrame, video: str, frame: str, true_id: str, said_id: str, similarity: str) -> DataFrame:
    """HOTA, DetA, AssA, LocA, DetRe and DetPr of each video, means over ALPHAS. ``pairs`` holds,
    for each frame, the similarity of each true and said object; an object without a partner has
    null on the other side.

    How well two ids align over the whole video is an aggregation. Frames are then assigned,
    favouring ids that align, by a solver on the frame's own few objects; frames are dealt to
    tasks one by one. What the matches amount to at each threshold is an aggregation again."""
    p = pairs.select(F.col(video).alias("v"), F.col(frame).alias("f"), F.col(true_id).alias("t"), F.col(said_id).alias("s"), F.col(similarity).cast("double").alias("x"))
    n_t = p.where("t is not null").select("v", "f", "t").distinct().groupBy("v", "t").agg(F.count("*").alias("nt"))
    n_s = p.where("s is not null").select("v", "f", "s").distinct().groupBy("v", "s").agg(F.count("*").alias("ns"))
    both = p.where("t is not null and s is not null and x is not null").groupBy("v", "f", "t", "s").agg(F.max("x").alias("x"))
    whole = F.sum("x").over(Window.partitionBy("v", "f", "t")) + F.sum("x").over(Window.partitionBy("v", "f", "s")) - F.col("x")
    shares = both.withColumn("w", whole).withColumn("share", F.when(F.col("w") > 1e-12, F.col("x") / F.col("w")).otherwise(0.0)).drop("w")
    align = shares.groupBy("v", "t", "s").agg(F.sum("share").alias("a")).join(n_t, ["v", "t"]).join(n_s, ["v", "s"])
    align = align.withColumn("g", F.col("a") / F.greatest(F.col("nt") + F.col("ns") - F.col("a"), F.lit(1e-12))).drop("a")
    scored = both.join(align, ["v", "t", "s"]).select("v", "f", "t", "s", "x", (F.col("g") * F.col("x")).alias("gain"), "nt", "ns")

    def assigned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for part in frames:
            part = part if held is None else pd.concat([held, part], ignore_index=True)
            new = np.flatnonzero(((part["v"] != part["v"].shift()) | (part["f"] != part["f"].shift())).to_numpy())
            if len(new) > 1:
                yield _assigned(part.iloc[: new[-1]], new[:-1])
            if len(new):
                held = part.iloc[new[-1] :]  # the last frame may go on in the next batch
        if held is not None and len(held):
            yield _assigned(held, np.zeros(1, np.int64))

    dealt = scored.repartition("v", "f").sortWithinPartitions("v", "f", "t", "s")
    matches = dealt.mapInPandas(assigned, scored.schema).select("v", "t", "s", "x", "nt", "ns")
    found = matches.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in ALPHAS]))).where(F.col("x") >= F.col("alpha") - 1e-12)
    links = found.groupBy("v", "alpha", "t", "s").agg(F.count("*").alias("m"), F.sum("x").alias("loc"), F.first("nt").alias("nt"), F.first("ns").alias("ns"))
    m = F.col("m")
    sums = links.groupBy("v", "alpha").agg(F.sum("m").alias("hits"), F.sum("loc").alias("loc"), F.sum(m * m / F.greatest(F.col("nt") + F.col("ns") - m, F.lit(1))).alias("ass"))
    totals = n_t.groupBy("v").agg(F.sum("nt").alias("nt")).join(n_s.groupBy("v").agg(F.sum("ns").alias("ns")), "v", "full").na.fill(0, ["nt", "ns"])
    every = totals.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in ALPHAS]))).join(sums, ["v", "alpha"], "left").na.fill(0, ["hits", "loc", "ass"])
    h, one = F.col("hits"), F.lit(1)
    det, ass = h / F.greatest(F.col("nt") + F.col("ns") - h, one), F.col("ass") / F.greatest(h, one)
    out = every.groupBy("v").agg(
        F.avg(F.sqrt(det * ass)).alias("hota"), F.avg(det).alias("det_a"), F.avg(ass).alias("ass_a"), F.avg(F.when(h > 0, F.col("loc") / h).otherwise(1.0)).alias("loc_a"),
        F.avg(h / F.greatest(F.col("nt"), one)).alias("det_re"), F.avg(h / F.greatest(F.col("ns"), one)).alias("det_pr"),
    )
    return out.withColumnRenamed("v", video)


def _assigned(rows: pd.DataFrame, begin: np.ndarray) -> pd.DataFrame:
    """Rows that the best matching of their frame takes; frames start at ``begin``."""
    gain, keep = rows["gain"].to_numpy(), []
    t, s = (pd.factorize(rows[c])[0] for c in ("t", "s"))
    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(rows)], strict=True):
        if b - a == 1:
            keep.append(a)
        elif b > a:
            ti, i = np.unique(t[a:b], return_inverse=True)
            si, j = np.unique(s[a:b], return_inverse=True)
            cost, at = np.zeros((len(ti), len(si))), np.full((len(ti), len(si)), -1)
            cost[i, j], at[i, j] = -gain[a:b], np.arange(a, b)
            keep += [int(at[x, y]) for x, y in best_assignment(cost) if at[x, y] >= 0]
    return rows.iloc[keep]


def matched_f1(pairs: DataFrame, by: list[str], true_id: str, said_id: str, distance: str, within: float) -> DataFrame:
    """F1 of each frame's best one-to-one matching of said to true points by distance."""
    rows = assigned(pairs, by, true_id, said_id, distance)
    out = rows.groupBy(*by).agg(F.count_if(F.col("taken") & (F.col("cost") <= within)).alias("hits"), F.count_distinct("said_id").alias("n_said"), F.count_distinct("true_id").alias("n_true"))
    out = out.withColumn("precision", F.col("hits") / F.col("n_said")).withColumn("recall", F.col("hits") / F.col("n_true"))
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-10)
    return out.select(*by, "hits", "precision", "recall", f1.alias("f1"))


def record_then_macro(df: DataFrame, record: str, values: list[str]) -> DataFrame:
    """Means of each record, and a row with a null record: the mean of the records' means, those
    that aren't numbers left out."""
    number = lambda c: F.when(~F.isnan(c), F.col(c))
    r = df.groupBy(record).agg(*[F.avg(c).alias(c) for c in values], F.count("*").alias("n"))
    whole = r.agg(*[F.avg(number(c)).alias(c) for c in values], F.count("*").alias("n"))
    return r.unionByName(whole.withColumn(record, F.lit(None).cast(r.schema[record].dataType)))


def video_score(frames: DataFrame, by: list[str], hit: str, said: str, true: str) -> DataFrame:
    """Means over frames of precision, recall and F1, and how many frames have what."""
    has_said, has_true = F.col(said) > 0, F.col(true) > 0
    p = F.when(has_said, F.try_divide(F.col(hit).cast("double"), F.col(said))).otherwise((~has_true).cast("double"))
    r = F.when(has_true, F.try_divide(F.col(hit).cast("double"), F.col(true))).otherwise((~has_said).cast("double"))
    f = frames.withColumn("_p", p).withColumn("_r", r)
    return f.groupBy(*by).agg(
        F.avg("_p").alias("precision"), F.avg("_r").alias("recall"), F.avg(2 * F.col("_p") * F.col("_r") / (F.col("_p") + F.col("_r") + 1e-10)).alias("f1"),
        F.count("*").alias("num_frames"), F.count_if(has_said).alias("frames_with_pred"), F.count_if(has_true).alias("frames_with_gt"), F.count_if(has_said & has_true).alias("frames_with_both"),
        F.count_if(has_said & ~has_true).alias("frames_pred_only"), F.count_if(has_true & ~has_said).alias("frames_gt_only"),
    )


def checked(value: Column, name: str) -> Column:
    """An aggregate that must be a number: NaN is an error."""
    return F.when(F.isnan(value), F.raise_error(F.lit(f"{name} is not a number")).cast("double")).otherwise(value)


def largest_shapes(df: DataFrame, key: str, shape: str, rank: int) -> DataFrame:
    """For each key the largest size in every dimension; all shapes must have the rank."""
    ok = F.when(F.size(shape) == rank, F.col(shape)).otherwise(F.raise_error(F.lit(f"a shape doesn't have {rank} dimensions")))
    rows = df.select(key, ok.alias("_s"))
    return rows.groupBy(key).agg(F.array(*[F.max(F.get("_s", F.lit(i))) for i in range(rank)]).alias(shape))


def evaluated_frames(df: DataFrame, by: list[str], frame: str, visible: Column, mode: str, stride: int = 5) -> DataFrame:
    """(by, query, frame): frames that count for a query frame. ``first``: those after the first
    visible frame; ``strided``: all but the query, of every stride-th frame that is visible."""
    rows = df.select(*by, F.col(frame).alias("frame"), visible.alias("_v"))
    if mode == "first":
        q = rows.where("_v").groupBy(*by).agg(F.min("frame").alias("query"))
        return rows.join(q, by).where("frame > query").drop("_v")
    if mode != "strided":
        raise ValueError(f"no mode {mode}")
    q = rows.where(F.col("_v") & (F.col("frame") % stride == 0)).select(*by, F.col("frame").alias("query"))
    return rows.join(q, by).where("frame <> query").drop("_v")


def least_cost(pairs: DataFrame, by: list[str], true_id: str, said_id: str, cost: str) -> DataFrame:
    """The cost of each group's best one-to-one matching."""
    rows = assigned(pairs, by, true_id, said_id, cost)
    return rows.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("taken"), F.col("cost"))), F.lit(0.0)).alias("cost"))
