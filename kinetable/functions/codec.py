"""Point tracks as text: ``<tracks coords="t id x y z id x y z;t ...">label</tracks>``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def encode_tracks(df: DataFrame, by: list[str], frame: str, point: str, xyz: list[str], label: str) -> DataFrame:
    """One text for each group from rows of visible points with whole-number coordinates. Frames
    and points come in order; a frame without points isn't written. Two aggregations, the first
    bounded by a frame's points and the second by a clip's frames."""
    one = F.concat_ws(" ", F.col(point).cast("string"), *[F.col(c).cast("string") for c in xyz])
    frames = df.groupBy(*by, frame).agg(F.array_sort(F.collect_list(F.struct(F.col(point).alias("p"), one.alias("s")))).alias("x"))
    text = F.concat(F.col(frame).cast("string"), F.lit(".0 "), F.array_join(F.transform("x", lambda v: v["s"]), " "))
    clips = frames.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(frame).alias("f"), text.alias("s")))).alias("x"))
    body = F.array_join(F.transform("x", lambda v: v["s"]), ";")
    return clips.select(*by, F.concat(F.lit('<tracks coords="'), body, F.lit(f'">{label}</tracks>')).alias("tracks"))


def decode_tracks(df: DataFrame, by: list[str], text: str) -> DataFrame:
    """Rows (frame time, point, x, y, z) of all blocks of a text. A later block's frame replaces an
    earlier one of the same time. Where a token isn't a whole number, reading goes on one
    token later, so that the rest of a damaged frame is still read."""
    blocks = F.regexp_extract_all(F.col(text), F.lit('<tracks[^>]*coords="([^"]*)"'), F.lit(1))
    rows = df.select(*by, F.posexplode(blocks).alias("block", "_b"))
    rows = rows.select(*by, "block", F.posexplode(F.split("_b", ";")).alias("_n", "_f"))
    tokens = F.filter(F.split(F.trim("_f"), "\\s+"), lambda t: t != "")
    rows = rows.select(*by, "block", "_n", F.try_element_at(tokens, F.lit(1)).try_cast("double").alias("time"), F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))).alias("_t")).where("time is not null")
    rows = rows.withColumn("points", _quads(F.transform("_t", lambda t: t.try_cast("long"))))
    last = rows.groupBy(*by, "time").agg(F.max_by("points", F.struct("block", "_n")).alias("points"))
    return last.select(*by, "time", F.inline("points"))


def _quads(numbers: Column) -> Column:
    """Groups of four numbers from left to right; a null where one should be shifts by one.

    A group begins at every fourth place of a stretch, and a null at place k of a group makes
    the next group begin one place after the group's begin; so the begins are found by one
    pass that keeps numbers only, and the groups are then read by their places."""
    n = F.size(numbers)

    def step(acc: Column, i: Column) -> Column:
        whole = ~F.exists(F.slice(numbers, i, 4), lambda v: v.isNull())
        ok = (i >= acc["next"]) & whole
        return F.struct(F.when(ok, i + 4).otherwise(acc["next"]).alias("next"), F.when(ok, F.concat(acc["at"], F.array(i))).otherwise(acc["at"]).alias("at"))

    at = lambda i: F.struct(*[F.get(numbers, i - 1 + k).alias(c) for k, c in enumerate(("point", "x", "y", "z"))])
    # no null: every fourth place, without a pass
    straight = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i % 4 == 1) & (i + 3 <= n))
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("at"))
    places = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: i + 3 <= n)
    searched = F.aggregate(places, start, step, lambda a: a["at"])
    return F.transform(F.when(F.exists(numbers, lambda v: v.isNull()), searched).otherwise(straight), at)


def decode_points(text: Column) -> Column:
    """(x, y) pairs of ``coords`` attributes of points, as an array of strings."""
    return F.regexp_extract_all(text, F.lit("(\\d+(?:\\.\\d+)?)[ ,]+(\\d+(?:\\.\\d+)?)"), F.lit(0))


def detect_format(text: Column) -> Column:
    """Which of the known text forms of tracks a text has."""
    return (
        F.when(text.rlike("<tracks[^>]*coords="), "tracks")
        .when(text.rlike("<points?[^>]*coords="), "points")
        .when(text.rlike("time\\s+\\d+(\\.\\d+)?\\s*\\{"), "frames")
        .when(text.rlike("\\d+\\s*:\\s*\\(\\["), "start_end")
        .when(text.rlike("\\[[^\\]]+,[^\\]]+,[^\\]]+\\]"), "triples")
        .otherwise("none")
    )
