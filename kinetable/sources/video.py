"""MP4 files as tables of frames: when each frame is shown, where its bytes lie and from which
frame decoding has to begin; a plan of seeks for wanted frames; and files cut to a range of frames
without encoding anything anew. Pictures themselves aren't decoded.

Only the headers of a file's parts and its table of samples are read, by byte ranges, where tasks
run; the pictures' bytes stay in the store. Frames are numbered as they are shown: samples whose
time an edit cuts off are none, but may be needed to decode later ones."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import write_grouped, write_made
from .stores import ranged

#: Boxes that hold boxes (fixed values).
HOLDERS = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf")
#: Columns of ``read_videos``.
FRAMES = "file string, frame long, sample long, key_sample long, begin double, end double, offset long, size long, width int, height int"


@dataclass
class Samples:
    """A track's samples in the order in which they are decoded: how long each lasts and how much
    later than decoded it is shown (in units of which ``scale`` make a second), whether it can be
    decoded alone, where its bytes are; and the time at which showing begins."""

    scale: int
    lasts: np.ndarray
    later: np.ndarray
    key: np.ndarray
    offset: np.ndarray
    size: np.ndarray
    start: int = 0
    width: int = 0
    height: int = 0
    stop: int | None = None  # what is shown lasts so long

    def shown(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the frames in order: their samples, and when they begin and end, in seconds."""
        at = np.cumsum(self.lasts) - self.lasts + self.later - self.start
        order = np.argsort(at, kind="stable")
        order = order[at[order] >= 0]
        begin = at[order]
        end = np.r_[begin[1:], begin[-1:] + self.lasts[order[-1:]]]
        n = len(order) if self.stop is None else int(np.searchsorted(begin, self.stop))
        return order[:n], begin[:n] / self.scale, end[:n] / self.scale

    def key_before(self) -> np.ndarray:
        """Of each sample the last one up to it that can be decoded alone (the first if none)."""
        return np.maximum.accumulate(np.where(self.key, np.arange(len(self.key)), 0))


# -- boxes ---------------------------------------------------------------------


def _box(kind: bytes, *parts: bytes) -> bytes:
    return struct.pack(">I4s", 8 + sum(map(len, parts)), kind) + b"".join(parts)


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def _heads(read: Callable[[int, int], bytes], begin: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, begin of the content, end) of the boxes in a range."""
    at = begin
    while at + 8 <= end:
        size, kind = struct.unpack(">I4s", read(at, 8))
        head = 8
        if size == 1:
            (size,), head = struct.unpack(">Q", read(at + 8, 8)), 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"a box {kind!r} at {at} doesn't fit")
        yield kind, at + head, at + size
        at += size


def _tree(data: bytes, begin: int, end: int) -> dict[bytes, list]:
    """Boxes by kind: contents, or trees of those that hold boxes."""
    out: dict[bytes, list] = {}
    for kind, a, b in _heads(lambda i, n: data[i : i + n], begin, end):
        out.setdefault(kind, []).append(_tree(data, a, b) if kind in HOLDERS else data[a:b])
    return out


def _table(content: bytes, kinds: str, skip: int = 4) -> np.ndarray:
    """Rows of a counted table: ``kinds`` are the types of a row's numbers."""
    (n,) = struct.unpack_from(">I", content, skip)
    row = np.dtype([(str(i), f">{k}") for i, k in enumerate(kinds.split())])
    if len(content) < skip + 4 + n * row.itemsize:
        raise ValueError("a table is cut off")
    return np.frombuffer(content, row, n, skip + 4)


def parse(read: Callable[[int, int], bytes], length: int) -> Samples:
    """The first picture track of a file that ``read`` (begin, length) gives."""
    moov = next(((a, b) for kind, a, b in _heads(read, 0, length) if kind == b"moov"), None)
    if moov is None:
        raise ValueError("no table of samples")
    data = read(moov[0], moov[1] - moov[0])
    top = _tree(data, 0, len(data))
    for track in top.get(b"trak", []):
        media = track[b"mdia"][0]
        if media[b"hdlr"][0][8:12] == b"vide":
            (movie,) = struct.unpack_from(">I", top[b"mvhd"][0], 20 if top[b"mvhd"][0][0] else 12)
            return _samples(track, media, media[b"minf"][0][b"stbl"][0], movie)
    raise ValueError("no pictures")


def _samples(track: dict, media: dict, table: dict, movie_scale: int) -> Samples:
    head = media[b"mdhd"][0]
    (scale,) = struct.unpack_from(">I", head, 20 if head[0] else 12)
    times = _table(table[b"stts"][0], "u4 u4")
    lasts = np.repeat(times["1"].astype(np.int64), times["0"])
    n = len(lasts)
    later = np.zeros(n, np.int64)
    if b"ctts" in table:
        shifts = _table(table[b"ctts"][0], "u4 i4" if table[b"ctts"][0][0] else "u4 u4")
        later = np.repeat(shifts["1"].astype(np.int64), shifts["0"])[:n]
    key = np.ones(n, bool)
    if b"stss" in table:
        key[:] = False
        key[_table(table[b"stss"][0], "u4")["0"].astype(np.int64) - 1] = True
    (one,) = struct.unpack_from(">I", table[b"stsz"][0], 4)
    size = np.full(n, one, np.int64) if one else _table(table[b"stsz"][0], "u4", 8)["0"].astype(np.int64)
    chunks = (_table(table[b"co64"][0], "u8") if b"co64" in table else _table(table[b"stco"][0], "u4"))["0"].astype(np.int64)
    runs = _table(table[b"stsc"][0], "u4 u4 u4")
    first = runs["0"].astype(np.int64) - 1
    held = np.repeat(runs["1"].astype(np.int64), np.diff(np.r_[first, len(chunks)]))  # samples of each chunk
    if len(size) != n or len(later) != n or held.sum() != n:
        raise ValueError("tables of different length")
    before = np.cumsum(size) - size
    at_chunk = np.cumsum(held) - held
    offset = np.repeat(chunks - before[np.minimum(at_chunk, max(n - 1, 0))], held) + before if n else before
    start, stop = 0, None
    if b"edts" in track:
        edit = track[b"edts"][0][b"elst"][0]
        rows = _table(edit, "u8 i8 i4" if edit[0] else "u4 i4 i4")
        for long, at in zip(rows["0"].tolist(), rows["1"].tolist(), strict=True):
            if at >= 0:  # else nothing is shown for a while
                start, stop = at, round(long * scale / movie_scale) if long else None
                break
    shape = track[b"tkhd"][0][-8:]
    width, height = (v >> 16 for v in struct.unpack(">II", shape))
    return Samples(scale, lasts, later, key, offset, size, start, width, height, stop)


def _pairs(values: np.ndarray) -> bytes:
    """Runs of equal values as (count, value)."""
    edge = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    n = np.diff(np.r_[edge, len(values)])
    return struct.pack(">I", len(edge)) + np.stack([n, values[edge]], 1).astype(">i4").tobytes()


def mux(samples: list[bytes], s: Samples, per_chunk: int = 4, front: bool = False) -> bytes:
    """A file of samples, whose bytes lie in chunks; ``front``: the table comes before them."""
    n = len(samples)
    kind = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")
    size = np.array([len(x) for x in samples], np.int64)
    total = int(s.lasts.sum())
    shown = max(total, int((np.cumsum(s.lasts) + s.later).max(initial=0))) - s.start if s.stop is None else s.stop
    matrix = struct.pack(">9i", 65536, 0, 0, 0, 65536, 0, 0, 0, 1 << 30)

    def moov(base: int) -> bytes:
        ends = np.cumsum(size) - size
        places = (base + ends[::per_chunk]).astype(">u4").tobytes()
        chunks = -(-n // per_chunk)
        rows = [(1, per_chunk, 1)] * (chunks > 0) + [(chunks, n - (chunks - 1) * per_chunk, 1)] * (chunks > 1 and n % per_chunk > 0)
        if chunks == 1:
            rows = [(1, n, 1)]
        entry = struct.pack(">I4s6xH16xHH50x", 86, b"raw ", 1, s.width, s.height)
        table = _box(
            b"stbl", _full(b"stsd", struct.pack(">I", 1), entry), _full(b"stts", _pairs(s.lasts)), _full(b"ctts", _pairs(s.later), version=1),
            _full(b"stss", struct.pack(">I", int(s.key.sum())), (np.flatnonzero(s.key) + 1).astype(">u4").tobytes()), _full(b"stsc", struct.pack(">I", len(rows)), *[struct.pack(">III", *r) for r in rows]),
            _full(b"stsz", struct.pack(">II", 0, n), size.astype(">u4").tobytes()), _full(b"stco", struct.pack(">I", chunks), places),
        )
        media = _box(
            b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, s.scale, total, 0x55C4, 0)), _full(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"\0"),
            _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table),
        )
        track = _full(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, shown, 0, 0, 0, 0), matrix, struct.pack(">II", s.width << 16, s.height << 16), flags=7)
        edit = _box(b"edts", _full(b"elst", struct.pack(">I", 1), struct.pack(">IiI", shown, s.start, 65536)))
        movie = _full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, s.scale, shown, 65536, 256), matrix, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", movie, _box(b"trak", track, edit, media))

    data = _box(b"mdat", *samples)
    if front:
        return kind + moov(len(kind) + len(moov(0)) + 8) + data
    return kind + data + moov(len(kind) + 8)


def trim(read: Callable[[int, int], bytes], length: int, first: int, last: int, front: bool = True) -> bytes:
    """The file of frames ``first`` to ``last`` (as shown): the samples that they need, from the one
    where decoding can begin, with tables of their own and an edit that shows no frame before
    ``first``. Nothing is encoded anew."""
    s = parse(read, length)
    order, _, _ = s.shown()
    if not 0 <= first <= last < len(order):
        raise ValueError(f"no frames {first} to {last} of {len(order)}")
    wanted = order[first : last + 1]
    a, b = int(s.key_before()[wanted.min()]), int(wanted.max()) + 1
    at = np.cumsum(s.lasts) - s.lasts
    begin = int((at + s.later)[order[first]] - at[a])
    end = int((at + s.later)[order[last + 1]]) if last + 1 < len(order) else int((at + s.later + s.lasts)[order[last]])
    stop = end - int((at + s.later)[order[first]])
    part = Samples(s.scale, s.lasts[a:b], s.later[a:b], s.key[a:b], s.offset[a:b], s.size[a:b], begin, s.width, s.height, stop)
    return mux([read(int(o), int(n)) for o, n in zip(part.offset, part.size, strict=True)], part, front=front)


# -- tables --------------------------------------------------------------------


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of the MP4 files of a folder, contents unread, dealt over tasks."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mp4").option("recursiveFileLookup", "true").load(folder)
    return files.select("path")


def read_videos(spark: SparkSession, folder: str, broken: str = "error") -> DataFrame:
    """FRAMES of all MP4 files; a broken one is an error, or left out (``broken="skip"``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    s = parse(*ranged(path))
                except (ValueError, KeyError, IndexError, struct.error) as e:
                    if broken == "skip":
                        continue
                    raise ValueError(f"{path}: {e}") from e
                order, begin, end = s.shown()
                n = len(order)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path.rpartition("/")[2]] * n), pa.array(np.arange(n)), pa.array(order), pa.array(s.key_before()[order]), pa.array(begin), pa.array(end), pa.array(s.offset[order]), pa.array(s.size[order]), pa.array([s.width] * n, pa.int32()), pa.array([s.height] * n, pa.int32())],
                    ["file", "frame", "sample", "key_sample", "begin", "end", "offset", "size", "width", "height"],
                )

    return listing(spark, folder).mapInArrow(run, FRAMES)


def seek_plan(frames: DataFrame, wanted: DataFrame) -> DataFrame:
    """For wanted frames (file, place, frame) in the order of ``place``: the frame that is shown
    there (``shown``: of a frame that isn't there the last before it that is, or -1 for black),
    whether a seek is needed (once, if a file's wanted frames follow each other without a gap),
    and from which sample to which has to be decoded for it."""
    w = Window.partitionBy("file").orderBy("place")
    whole = Window.partitionBy("file")
    x = wanted.select("file", "place", "frame").join(frames.select("file", "frame", "sample", "key_sample"), ["file", "frame"], "left")
    row = F.when(F.col("sample").isNotNull(), F.struct(F.col("frame").alias("shown"), "sample", "key_sample"))
    x = x.withColumn("_r", F.last(row, True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    gapless = (F.max("frame").over(whole) - F.min("frame").over(whole) + 1 == F.count("*").over(whole)) & (F.size(F.collect_set("frame").over(whole)) == F.count("*").over(whole))
    x = x.withColumns({"_one": gapless, "_nth": F.row_number().over(Window.partitionBy("file").orderBy("frame", "place"))})
    follows = F.col("_one") & (F.col("_nth") > 1)
    seek = F.col("sample").isNotNull() & ~follows
    begin = F.when(F.col("sample").isNotNull(), F.when(follows, F.col("sample")).otherwise(F.col("key_sample")))
    return x.select("file", "place", "frame", F.coalesce("_r.shown", F.lit(-1)).alias("shown"), seek.alias("seek"), begin.alias("from_sample"), F.col("sample").alias("to_sample"))


def write_videos(rows: DataFrame, folder: str, scale: int = 1000, width: int = 64, height: int = 48, per_chunk: int = 4) -> str:
    """Rows (file, place, lasts, later, key, data) as an MP4 file each, samples by ``place``."""

    def build(group: pa.Table) -> bytes:
        order = np.argsort(group["place"].to_numpy())
        col = lambda n: group[n].to_numpy(zero_copy_only=False)[order]
        s = Samples(scale, col("lasts").astype(np.int64), col("later").astype(np.int64), col("key"), np.zeros(0), np.zeros(0), 0, width, height)
        data = group["data"].to_pylist()
        return mux([data[i] for i in order], s, per_chunk)

    return write_grouped(rows.select("file", "place", "lasts", "later", "key", "data"), folder, build)


def trim_videos(spark: SparkSession, folder: str, ranges: DataFrame, target: str) -> str:
    """Cut files to ranges (file, first, last, path) of frames and write them below ``target``."""

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        for b in batches:
            for place, first, last, path in zip(*[c.to_pylist() for c in b.columns], strict=True):
                yield path, trim(*ranged(place), first, last)

    found = listing(spark, folder).withColumnRenamed("path", "place").withColumn("file", F.substring_index("place", "/", -1))
    cut = found.join(ranges, "file").select("place", F.col("first").cast("long"), F.col("last").cast("long"), "path")
    return write_made(cut, target, cuts)
