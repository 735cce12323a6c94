"""Pictures as PNG files and back, and lines drawn into them, in Arrow batches, with the standard
library and NumPy alone."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import write_files

_HEAD = b"\x89PNG\r\n\x1a\n"
#: Bytes of a pixel by the kind of colour (fixed values): grey, colours, places in a palette, grey and opacity, colours and opacity.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Pictures that a task has as values at once; an Arrow batch may hold 10,000.
FEW = 64
#: Colours of lines, one after the other.
PALETTE = ((230, 60, 60), (60, 160, 240), (70, 200, 90), (240, 190, 50), (170, 90, 220), (240, 130, 40))


def png(pixels: np.ndarray) -> bytes:
    """An 8-bit picture: rows of grey values, or of two, three or four values a pixel."""
    pixels = np.asarray(pixels, np.uint8)
    h, w, n = (*pixels.shape, 1)[:3]
    kind = {1: 0, 3: 2, 2: 4, 4: 6}[n]
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    rows = np.zeros((h, 1 + w * n), np.uint8)
    rows[:, 1:] = pixels.reshape(h, -1)
    return _HEAD + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def _plain(rows: np.ndarray, n: int) -> np.ndarray:
    """Rows without their filters: a byte stands for its difference to what is left of it, above,
    between both, or the nearest of three."""
    h, size = rows.shape[0], rows.shape[1] - 1
    out, above = np.zeros((h, size // n, n), np.int64), np.zeros((size // n, n), np.int64)
    for y in range(h):
        kind, own = rows[y, 0], rows[y, 1:].reshape(-1, n).astype(np.int64)
        if kind == 1:
            own = np.cumsum(own, 0)
        elif kind == 2:
            own = own + above
        elif kind in (3, 4):
            left, corner = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for x in range(len(own)):
                up = above[x]
                if kind == 3:
                    left = (own[x] + (left + up) // 2) % 256
                else:
                    a, b, c = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
                    left = (own[x] + np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))) % 256
                own[x], corner = left, up
        elif kind:
            raise ValueError(f"no filter {kind}")
        out[y] = above = own % 256
    return out.astype(np.uint8)


def picture(content: bytes) -> np.ndarray:
    """Rows of pixels of an 8-bit picture, with as many values a pixel as it has; places in a
    palette become colours."""
    if content[:8] != _HEAD:
        raise ValueError("no PNG file")
    at, data, size, palette = 8, b"", None, None
    while at < len(content):
        n, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data += body
        at += n + 12
    w, h, bits, colour, _, _, woven = size
    if bits != 8 or woven or colour not in CHANNELS:
        raise ValueError("only 8-bit pictures whose rows follow each other are read")
    out = _plain(np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, -1), CHANNELS[colour])
    return palette[out[..., 0]] if colour == 3 else out


def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in slices of FEW rows."""
    for b in batches:
        for k in range(0, b.num_rows, FEW):
            yield b.slice(k, FEW)


def _rows(column: pa.Array) -> Iterator[np.ndarray | None]:
    """Lists of numbers as arrays, without a Python object for each number."""
    for v in column:
        yield v.values.to_numpy(zero_copy_only=False) if v.is_valid else None


def grey(content: bytes) -> np.ndarray:
    """Pixels of an 8-bit grey picture."""
    p = picture(content)
    if p.shape[2] != 1:
        raise ValueError("the picture has colours")
    return p[..., 0]


def write_pictures(df: DataFrame, folder: str, name: str, pixels: str, width: int, channels: int = 1) -> str:
    """A picture a row, from a flat array of values; tasks write in parallel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            out = [png(v.astype(np.uint8).reshape(-1, width, channels)) for v in _rows(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["path", "content"])

    return write_files(df.select(name, pixels).mapInArrow(run, "path string, content binary"), folder)


def read_pictures(spark: SparkSession, folder: str) -> DataFrame:
    """(file, height, width, channels, pixels)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            p = [picture(c) for c in b.column(1).to_pylist()]
            names = [x.rpartition("/")[2] for x in b.column(0).to_pylist()]
            shape = [pa.array([x.shape[i] for x in p], pa.int32()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *shape, pa.array([x.ravel().astype(np.int32) for x in p], pa.list_(pa.int32()))], ["file", "height", "width", "channels", "pixels"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").mapInArrow(run, "file string, height int, width int, channels int, pixels array<int>")


# -- lines -----------------------------------------------------------------------


def stroke(points: np.ndarray) -> np.ndarray:
    """Pixels (x, y) of a line through points: from each to the next in steps of one along the
    longer side, halves up. A point that isn't a number parts the line."""
    out = []
    at = np.floor(points + 0.5)
    for a, b in zip(at, at[1:], strict=False):
        if np.isfinite(a).all() and np.isfinite(b).all():
            n = int(np.abs(b - a).max())
            out.append(np.floor(a + (b - a) * np.arange(n + 1)[:, None] / max(n, 1) + 0.5))
    if not out:
        out = [at[:1]] if len(at) and np.isfinite(at[:1]).all() else [np.zeros((0, 2))]
    return np.concatenate(out).astype(np.int64)


def paint(pixels: np.ndarray, spots: np.ndarray, radius: float, colour) -> None:
    """Discs of a radius around pixels, as far as they lie inside the picture."""
    r = int(radius)
    dx, dy = np.meshgrid(np.arange(-r, r + 1), np.arange(-r, r + 1))
    disc = np.stack([dx, dy], -1)[dx * dx + dy * dy <= radius * radius]
    p = (spots[:, None] + disc).reshape(-1, 2)
    h, w = pixels.shape[:2]
    p = p[(p[:, 0] >= 0) & (p[:, 0] < w) & (p[:, 1] >= 0) & (p[:, 1] < h)]
    pixels[p[:, 1], p[:, 0]] = colour


def overlay(df: DataFrame, key: str, pixels: str, width: int, lines: str, thick: int = 2, dot: int = 3, palette=PALETTE) -> DataFrame:
    """(key, pixels): pictures (flat arrays of three values a pixel) with a line for each list of x
    and y, and a dot on each of its points but the first that lies inside. Lines take the
    palette's colours in turn; a null picture stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            out = []
            for flat, paths in zip(_rows(b.column(1)), b.column(2).to_pylist(), strict=True):
                if flat is None:
                    out.append(None)
                    continue
                p = flat.astype(np.uint8).reshape(-1, width, 3)
                for i, line in enumerate(paths or []):
                    points = np.asarray([np.nan if v is None else v for v in line], float).reshape(-1, 2)
                    paint(p, stroke(points), (thick - 1) / 2, palette[i % len(palette)])
                    marks = np.floor(points[1:] + 0.5)
                    paint(p, marks[np.isfinite(marks).all(1) & (marks >= 0).all(1) & (marks < (p.shape[1], p.shape[0])).all(1)].astype(np.int64), dot, palette[i % len(palette)])
                out.append(p.ravel().astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int32()))], ["key", "pixels"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(pixels).cast("array<int>"), F.col(lines).cast("array<array<double>>"))
    return rows.mapInArrow(run, f"key {kind}, pixels array<int>").withColumnRenamed("key", key)
