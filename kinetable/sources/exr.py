"""Depth pictures in the EXR format: scan lines, uncompressed, run-length coded or deflated, of
half, float or whole numbers; single files or members of ZIP archives, of which only what is wanted
is read."""

from __future__ import annotations

import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stores import store

#: First bytes of a file; kinds of samples by their number; lines in a block by the way of packing (fixed values).
MAGIC = b"\x76\x2f\x31\x01"
KINDS = ("<u4", "<f2", "<f4")
LINES = {0: 1, 1: 1, 2: 1, 3: 16}
#: A member's name ends in its frame. Bytes of pictures that a task sends on at once.
FRAME, BATCH_BYTES = re.compile(r"(\d{5,})\.exr$"), 8 << 20


def _name(data: bytes, at: int) -> tuple[bytes, int]:
    end = data.index(b"\0", at)
    return data[at:end], end + 1


def head(data: bytes) -> tuple[dict[bytes, bytes], int]:
    """Attributes by name, and where they end."""
    if data[:4] != MAGIC or data[5] & 0x1A:  # tiles, deep data and several parts aren't read
        raise ValueError("no single picture of scan lines")
    at, out = 8, {}
    while data[at]:
        name, at = _name(data, at)
        _, at = _name(data, at)
        (n,) = struct.unpack_from("<i", data, at)
        out[name], at = data[at + 4 : at + 4 + n], at + 4 + n
    return out, at + 1


def channels(content: bytes) -> list[tuple[str, int]]:
    """(name, kind) in the file's order."""
    at, out = 0, []
    while content[at]:
        name, at = _name(content, at)
        kind, _, dx, dy = struct.unpack_from("<iB3xii", content, at)
        if dx != 1 or dy != 1:
            raise ValueError("a channel isn't of full size")
        out.append((name.decode(), kind))
        at += 16
    return out


def _unpacked(data: bytes, way: int, size: int) -> bytes:
    """Lines of a block; a block that packing didn't shorten is as it is."""
    if way == 0 or len(data) == size:
        return data
    if way == 1:
        out, at = bytearray(), 0
        while at < len(data):
            n = struct.unpack_from("b", data, at)[0]
            out += data[at + 1 : at + 1 - n] if n < 0 else data[at + 1 : at + 2] * (n + 1)
            at += 1 - n if n < 0 else 2
        raw = bytes(out)
    else:
        raw = zlib.decompress(data)
    d = np.frombuffer(raw, np.uint8).astype(np.int64)
    d[1:] -= 128  # each byte is the difference to the one before, and odd bytes come after even ones
    d = np.cumsum(d).astype(np.uint8)
    out = np.empty_like(d)
    half = (len(d) + 1) // 2
    out[::2], out[1::2] = d[:half], d[half:]
    return out.tobytes()


def decode(data: bytes, channel: str = "Z") -> np.ndarray:
    """The picture of a channel, or of the first one if there is none of that name."""
    attributes, at = head(data)
    left, top, right, bottom = struct.unpack("<4i", attributes[b"dataWindow"])
    width, height = right - left + 1, bottom - top + 1
    way, own = attributes[b"compression"][0], channels(attributes[b"channels"])
    if way not in LINES:
        raise ValueError(f"packing {way} isn't read")
    names = [n for n, _ in own]
    pick = names.index(channel) if channel in names else 0
    before = width * sum(np.dtype(KINDS[k]).itemsize for _, k in own[:pick])
    line = width * sum(np.dtype(KINDS[k]).itemsize for _, k in own)
    kind = np.dtype(KINDS[own[pick][1]])
    out = np.zeros((height, width), kind)
    for place in struct.unpack_from(f"<{-(-height // LINES[way])}Q", data, at):
        y, n = struct.unpack_from("<ii", data, place)
        rows = min(LINES[way], bottom - y + 1)
        raw = _unpacked(data[place + 8 : place + 8 + n], way, rows * line)
        for i in range(rows):
            out[y - top + i] = np.frombuffer(raw, kind, width, i * line + before)
    return out.astype(np.float32)


def encode(layers: dict[str, np.ndarray], way: int = 3) -> bytes:
    """A file of channels (float16, float32 or uint32), deflated (3: 16 lines a block, 2: one) or as they are (0)."""
    height, width = next(iter(layers.values())).shape
    own = sorted(layers.items())
    kinds = {np.dtype(k): i for i, k in enumerate(KINDS)}
    listed = b"".join(n.encode() + b"\0" + struct.pack("<iB3xii", kinds[v.dtype], 0, 1, 1) for n, v in own) + b"\0"
    window = struct.pack("<4i", 0, 0, width - 1, height - 1)
    attributes = [("channels", "chlist", listed), ("compression", "compression", bytes([way])), ("dataWindow", "box2i", window), ("displayWindow", "box2i", window), ("lineOrder", "lineOrder", b"\0"), ("pixelAspectRatio", "float", struct.pack("<f", 1)), ("screenWindowCenter", "v2f", bytes(8)), ("screenWindowWidth", "float", struct.pack("<f", 1))]
    begin = MAGIC + struct.pack("<i", 2) + b"".join(n.encode() + b"\0" + k.encode() + b"\0" + struct.pack("<i", len(v)) + v for n, k, v in attributes) + b"\0"
    blocks = []
    for y in range(0, height, LINES[way]):
        raw = b"".join(v[i].tobytes() for i in range(y, min(height, y + LINES[way])) for _, v in own)
        packed = raw
        if way:
            b = np.frombuffer(raw, np.uint8)
            b = np.r_[b[::2], b[1::2]].astype(np.int64)
            packed = zlib.compress(np.r_[b[:1], (np.diff(b) + 128) & 255].astype(np.uint8).tobytes())
        blocks.append(struct.pack("<ii", y, min(len(packed), len(raw))) + min(packed, raw, key=len))
    at = len(begin) + 8 * len(blocks) + np.cumsum([0, *map(len, blocks)])[:-1]
    return begin + at.astype("<u8").tobytes() + b"".join(blocks)


def read_depth(spark: SparkSession, folder: str, wanted: DataFrame | None = None) -> DataFrame:
    """(file, frame, height, width, depth) of the archives of a folder, whose members are named by
    their frame (five digits or more). ``wanted`` (file, frame): only these; those that aren't there give
    no rows. Archives are read member by member, where tasks run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, frames in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                files, place = store(path)
                with files.open_input_file(place) as f, zipfile.ZipFile(f) as z:
                    there = {int(m[1]): n for n in z.namelist() if (m := FRAME.search(n))}
                    every, held = sorted(there if frames is None else there.keys() & set(frames)), []
                    for k in every:
                        held.append((k, decode(z.read(there[k]))))
                        if k == every[-1] or len(held) * held[0][1].nbytes >= BATCH_BYTES:
                            n = len(held)
                            shape = [pa.array([d.shape[i] for _, d in held], pa.int32()) for i in range(2)]
                            yield pa.RecordBatch.from_arrays([pa.array([path.rpartition("/")[2]] * n), pa.array([k for k, _ in held], pa.int64()), *shape, pa.array([d.ravel() for _, d in held], pa.list_(pa.float32()))], ["file", "frame", "height", "width", "depth"])
                            held = []

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(folder).select("path")
    if wanted is None:
        files = files.withColumn("frames", F.lit(None).cast("array<long>"))
    else:
        per_file = wanted.groupBy("file").agg(F.collect_set(F.col("frame").cast("long")).alias("frames"))
        files = files.withColumn("file", F.substring_index("path", "/", -1)).join(per_file, "file").select("path", "frames")
    return files.mapInArrow(run, "file string, frame long, height int, width int, depth array<float>")
