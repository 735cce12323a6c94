"""Depth maps in archives: whole millimetres, pictures by place, and the frames' places."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .files import write_files
from .tracks import load_archive


def write_depth(rows: DataFrame, folder: str, width: int) -> str:
    """Rows (file, place, frame, mm: flat array) as an archive a file: ``depth`` and ``indices``."""

    def build(key, group):
        place = group["place"].to_numpy()
        order = np.argsort(place)
        maps = np.array([np.asarray(v, np.uint16).reshape(-1, width) for v in group["mm"].to_pylist()])[order]
        out = io.BytesIO()
        np.savez(out, depth=maps, indices=group["frame"].to_numpy()[order])
        return pa.table({"path": pa.array([key[0].as_py()]), "content": pa.array([out.getvalue()], pa.binary())})

    return write_files(rows.groupBy("file").applyInArrow(build, "path string, content binary"), folder)


def read_depth(spark: SparkSession, folder: str) -> DataFrame:
    """(file, frame, height, width, mm): each map with the frame that the index names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                z = load_archive(content)
                maps = z["depth"]
                frames = z["indices"] if "indices" in z else np.arange(len(maps))
                n = len(maps)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path.rpartition("/")[2]] * n), pa.array(frames, pa.int64()), pa.array([maps.shape[1]] * n, pa.int32()), pa.array([maps.shape[2]] * n, pa.int32()), pa.array(list(maps.reshape(n, -1).astype(np.int32)), pa.list_(pa.int32()))],
                    ["file", "frame", "height", "width", "mm"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").mapInArrow(run, "file string, frame long, height int, width int, mm array<int>")
