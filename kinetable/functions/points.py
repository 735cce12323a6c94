"""Text forms of image and video points: writers and readers as expressions.

Unified form: ``<points coords="1 001 520 407;2 ...">label</points>``: frames parted by ``;``, each a
number (or time) and triples of id, x and y, in thousandths of the width and height."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import at_least


def scale(value: Column, size: Column, to: int = 1000) -> Column:
    """Pixels to thousandths, kept inside the picture."""
    return F.least(F.lit(to), F.greatest(F.lit(0), F.rint(value / size * to).cast("int")))


def unscale(value: Column, size: Column, of: int = 1000) -> Column:
    return value.cast("double") / of * size


def encode_points(df: DataFrame, by: list[str], frame: str, point: str, x: str, y: str, label: str) -> DataFrame:
    """Rows of scaled points to one text a group; ids are renumbered from 1 by first frame and id."""
    w = Window.partitionBy(*by).orderBy("_f0", point)
    first = df.groupBy(*by, point).agg(F.min(frame).alias("_f0"))
    ids = first.withColumn("_id", F.row_number().over(w)).drop("_f0")
    own = df.join(ids, [*by, point])
    three = lambda c: at_least(F.col(c).cast("string"), 3)
    one = F.concat_ws(" ", F.col("_id").cast("string"), three(x), three(y))
    frames = own.groupBy(*by, frame).agg(F.array_sort(F.collect_list(F.struct(F.col("_id").alias("i"), one.alias("s")))).alias("v"))
    line = F.concat_ws(" ", F.col(frame).cast("string"), F.array_join(F.transform("v", lambda v: v["s"]), " "))
    out = frames.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(frame).alias("f"), line.alias("s")))).alias("v"))
    return out.select(*by, F.concat(F.lit('<points coords="'), F.array_join(F.transform("v", lambda v: v["s"]), ";"), F.lit(f'">{label}</points>')).alias("points"))


def decode_points(df: DataFrame, by: list[str], text: str, limit: int = 1000) -> DataFrame:
    """(time, id, x, y) rows of all blocks; points outside the picture go, and of one id in a frame
    the first stays."""
    block = F.explode(F.regexp_extract_all(F.col(text), F.lit('<(?:points|tracks)[^>]*coords="([^"]*)"'), F.lit(1)))
    rows = df.select(*by, block.alias("_b")).select(*by, F.posexplode(F.split("_b", ";")).alias("_n", "_f"))
    t = F.regexp_extract("_f", "^\\s*(\\d+(?:\\.\\d+)?)", 1).try_cast("double")
    hits = F.regexp_extract_all(F.regexp_replace("_f", "^\\s*\\d+(?:\\.\\d+)?", ""), F.lit("(\\d+) +(\\d{3,4}) +(\\d{3,4})"), F.lit(0))
    rows = rows.select(*by, t.alias("time"), F.posexplode(hits).alias("_k", "_p")).where("time is not null")
    part = lambda i: F.get(F.split("_p", " +"), F.lit(i)).cast("int")
    rows = rows.select(*by, "time", "_k", part(0).alias("id"), part(1).alias("x"), part(2).alias("y")).where((F.col("x") <= limit) & (F.col("y") <= limit))
    w = Window.partitionBy(*by, "time", "id").orderBy("_k")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_k")


def frame_points(df: DataFrame, by: list[str], text: str) -> DataFrame:
    """Rows of ``time 0.50 {0: [52.4, 40.7, yes], ...}``: time, id, x, y, visible."""
    blocks = F.explode(F.regexp_extract_all(F.col(text), F.lit("time\\s+\\d+(?:\\.\\d+)?\\s*\\{[^}]*\\}"), F.lit(0)))
    rows = df.select(*by, blocks.alias("_b"))
    items = F.explode(F.regexp_extract_all("_b", F.lit("\\d+\\s*:\\s*\\[[^\\]]*\\]"), F.lit(0)))
    rows = rows.select(*by, F.regexp_extract("_b", "time\\s+(\\d+(?:\\.\\d+)?)", 1).cast("double").alias("time"), items.alias("_p"))
    part = lambda i: F.trim(F.get(F.split(F.regexp_extract("_p", "\\[([^\\]]*)\\]", 1), ","), F.lit(i)))
    return rows.select(*by, "time", F.regexp_extract("_p", "^(\\d+)", 1).cast("int").alias("id"), part(0).try_cast("double").alias("x"), part(1).try_cast("double").alias("y"), (F.coalesce(F.lower(part(2)), F.lit("no")) != "yes").alias("visible"))


def start_end_points(df: DataFrame, by: list[str], text: str) -> DataFrame:
    """Rows of ``0: ([x,y,t],[x,y,t])``: id, which end, x, y, t; coordinates over 100 go."""
    items = F.explode(F.regexp_extract_all(F.col(text), F.lit("\\d+\\s*:\\s*\\(\\[[^\\]]*\\]\\s*,\\s*\\[[^\\]]*\\]\\)"), F.lit(0)))
    rows = df.select(*by, items.alias("_p"))
    ends = F.posexplode(F.regexp_extract_all("_p", F.lit("\\[([^\\]]*)\\]"), F.lit(1)))
    rows = rows.select(*by, F.regexp_extract("_p", "^(\\d+)", 1).cast("int").alias("id"), ends.alias("end", "_e"))
    part = lambda i: F.trim(F.get(F.split("_e", ","), F.lit(i))).try_cast("double")
    return rows.select(*by, "id", "end", part(0).alias("x"), part(1).alias("y"), part(2).alias("t")).where(F.greatest("x", "y") <= 100)


def to_frame(seconds: Column, fps: Column, truncate: bool = False) -> Column:
    """Frame of a time, halves to even, or cut off."""
    return (seconds * fps).cast("long") if truncate else F.rint(seconds * fps).cast("long")


def dataset_parameters(name: Column) -> Column:
    """Points, history and future of a name ``trajectory..._p8_h3_f30``; all null if one is missing."""
    part = lambda k: F.regexp_extract(name, f"_{k}(\\d+)(?:_|$)", 1).try_cast("int")
    ok = part("p").isNotNull() & part("h").isNotNull() & part("f").isNotNull()
    return F.struct(F.when(ok, part("p")).alias("points"), F.when(ok, part("h")).alias("history"), F.when(ok, part("f")).alias("future"))


def frame_prefix(mode: str, number: Column, seconds: Column) -> Column:
    """Text before a frame: numbered, timed with one or two decimals (halves to even), or none."""
    if mode == "number":
        return F.concat(F.lit("frame "), number.cast("string"))
    if mode in ("time1", "time2"):
        k = int(mode[-1])
        n = F.rint(seconds * 10**k).cast("long")
        return F.concat(F.lit("time "), F.floor(n / 10**k).cast("string"), F.lit("."), F.lpad((n % 10**k).cast("string"), k, "0"))
    return F.lit("")


def frame_time(frame: Column, fps: Column) -> Column:
    """Seconds of a frame; a frame before the first or a rate of nothing is an error."""
    bad = F.raise_error(F.lit("frames and rates must be positive")).cast("double")
    return F.when((frame >= 0) & (fps > 0), frame / fps).otherwise(bad)


def clip_frames(begin: Column, end: Column, fps: Column) -> tuple[Column, Column]:
    """First and last frame of a clip in seconds; an end before the begin is an error."""
    bad = F.raise_error(F.lit("a clip must end after its begin")).cast("long")
    ok = (begin >= 0) & (end > begin)
    return F.when(ok, F.floor(begin * fps).cast("long")).otherwise(bad), F.when(ok, F.ceil(end * fps).cast("long")).otherwise(bad)
