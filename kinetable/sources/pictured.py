"""Points of pictures at one frame, from archives of every form in which sources keep them.

A form says in which archives to look, under which names, how the axes lie, whether every frame is
kept, where the picture's size is, and whether objects are blocks of one array (in the order and
sizes of the archive of their points in space). Archives become long rows, requests are joined to
them, and a request of which any point is missing (no archive, object, point or frame) gives
nulls. Coordinates are shares of the picture, cut to 0 to 1; what isn't a number is half of the
picture's width in either direction, as the sources' own readers have it.

One form reads axes in the wrong order (``swapped``): a request's points then are frames and its
frame a point, which is what those readers give."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tracks import FLAT, load_archive, read_tracks


@dataclass(frozen=True)
class Form:
    """Suffix of the archives; names of the points' array, the first that is there; layout ("tnc":
    frames first, "ntc": points first); every how many frames; name of the array with height and
    width, or these numbers; and the suffix of the archive whose objects are the blocks."""

    suffix: str = "_2d.npz"
    points: tuple[str, ...] = ("tracks",)
    layout: str = "tnc"
    stride: int = 1
    size: str | tuple[int, int] = "dim"
    blocks: str | None = None


#: Forms by name. Which source has which is the catalogue's business.
FORMS = {
    "frames": Form(),
    "named_size": Form(points=("tracks_2d",), size="ds_dim"),
    "strided": Form(stride=2),
    "inside": Form(suffix=".npz", points=("tracks_2d", "pixel_coords"), layout="ntc", size=(512, 512)),
    "blocks": Form(blocks="_3d.npz"),
    "fixed": Form(size=(480, 854)),
    "swapped": Form(layout="ntc"),
}


def _archives(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(folder).select("path", "content")


def sizes(spark: SparkSession, folder: str, suffix: str, name: str) -> DataFrame:
    """(file, height, width) from one small array of each archive; others aren't unpacked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    if f"{name}.npy" in z.namelist():
                        v = np.load(io.BytesIO(z.read(f"{name}.npy")), allow_pickle=False)
                        rows.append((path.rpartition("/")[2], int(v[0]), int(v[1])))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32()))], ["file", "height", "width"])

    return _archives(spark, folder, suffix).mapInArrow(run, "file string, height int, width int")


def block_starts(spark: SparkSession, folder: str, suffix: str, points: str = "points_3d") -> DataFrame:
    """(file, obj, before, n_points): where each object's block begins, objects in the archive's
    own order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                z, before = load_archive(content), 0
                own = z[points].item() if points in z and z[points].dtype == object else {}
                for obj, v in own.items():
                    rows.append((path.rpartition("/")[2], obj, before, len(v)))
                    before += len(v)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], ["file", "obj", "before", "n_points"])

    return _archives(spark, folder, suffix).mapInArrow(run, "file string, obj string, before long, n_points long")


def picture_points(spark: SparkSession, folder: str, form: Form, requests: DataFrame) -> DataFrame:
    """(stem, obj, point_id, frame, x, y) of requests (stem, obj, point_id, frame); an archive
    without objects answers for any."""
    rows = None
    for nth, name in enumerate(form.points):
        one = read_tracks(spark, folder, f"*{form.suffix}", points=name, visible="", layout=form.layout, stride=form.stride).withColumn("nth", F.lit(nth))
        rows = one if rows is None else rows.unionByName(one)
    stem = F.expr(f"left(file, length(file) - {len(form.suffix)})")
    rows = rows.select(stem.alias("stem"), F.col("obj").alias("of"), F.col("point_id").cast("long").alias("at"), F.col("frame").cast("long").alias("frame"), "x", "y", "nth")
    if len(form.points) > 1:  # the first name that is there
        first = rows.groupBy("stem").agg(F.min("nth").alias("nth"))
        rows = rows.join(first, ["stem", "nth"], "left_semi")
    asked = requests.select("stem", "obj", F.col("point_id").cast("long").alias("point_id"), F.col("frame").cast("long").alias("frame")).withColumn("at", F.col("point_id"))
    if form.blocks:
        starts = block_starts(spark, folder, form.blocks).withColumn("stem", F.expr(f"left(file, length(file) - {len(form.blocks)})")).drop("file")
        asked = asked.join(starts, ["stem", "obj"], "left").withColumn("at", F.when(F.col("point_id") < F.col("n_points"), F.col("at") + F.col("before")))
    found = asked.join(rows.withColumn("there", F.lit(True)), (asked["stem"] == rows["stem"]) & (asked["at"] == rows["at"]) & (asked["frame"] == rows["frame"]) & ((rows["of"] == asked["obj"]) | (rows["of"] == FLAT)), "left")
    found = found.select(asked["stem"], "obj", "point_id", asked["frame"], "x", "y", F.coalesce("there", F.lit(False)).alias("there"))
    whole = found.groupBy("stem", "obj", "frame").agg(F.min("there").alias("whole"))
    found = found.join(whole, ["stem", "obj", "frame"])
    if isinstance(form.size, str):
        size = sizes(spark, folder, form.suffix, form.size).withColumn("stem", F.expr(f"left(file, length(file) - {len(form.suffix)})")).drop("file")
        found = found.join(size, "stem", "left")
    else:
        found = found.withColumns({"height": F.lit(form.size[0]), "width": F.lit(form.size[1])})
    share = lambda c, n: F.when(F.col("whole"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(c).cast("double"), F.col("width") / 2) / F.col(n))))
    return found.select("stem", "obj", "point_id", "frame", share("x", "width").alias("x"), share("y", "height").alias("y"))
