"""Arrays and texts in HDF5 files of the older layout (superblock 0 or 1, symbol tables), read by
byte ranges where tasks run: groups by their trees of names, arrays that lie in one piece or in
chunks (deflated, shuffled, with checksums), of which only the chunks of the wanted rows are read,
and texts of fixed or varying length. Newer layouts are an error."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stores import ranged

#: First bytes of a file; an address that isn't set (fixed values).
MAGIC, NOWHERE = b"\x89HDF\r\n\x1a\n", (1 << 64) - 1
SPACE, KIND, LAYOUT, FILTERS, MORE, NAMES = 0x01, 0x03, 0x08, 0x0B, 0x10, 0x11
DEFLATE, SHUFFLE, CHECKSUM = 1, 2, 3
#: Rows of an array that a task reads in one go; bytes of rows that it sends on at once.
BLOCK_ROWS, BATCH_BYTES = 4096, 8 << 20


@dataclass
class Array:
    """What a header says of an array."""

    shape: tuple[int, ...] = ()
    kind: np.dtype | None = None  # None: text of varying length
    layout: tuple = ()
    filters: list[tuple[int, tuple[int, ...]]] = field(default_factory=list)


class File:
    """A file that ``read`` (begin, length) gives."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read = read
        top = read(0, 104)
        if top[:8] != MAGIC or top[8] > 1 or top[13:15] != b"\x08\x08":
            raise ValueError("no file of the older layout")
        self.root = struct.unpack_from("<Q", top, (60 if top[8] else 56) + 8)[0]
        self.groups: dict[int, dict[str, int]] = {}

    def messages(self, address: int) -> list[tuple[int, bytes]]:
        version, n, size = struct.unpack("<BxH4xI", self.read(address, 12))
        if version != 1:
            raise ValueError("a header of a newer layout")
        out, blocks = [], [(address + 16, size)]
        for at, length in blocks:
            data, k = self.read(at, length), 0
            while k + 8 <= len(data) and len(out) < n:
                kind, m = struct.unpack_from("<HH", data, k)
                body = data[k + 8 : k + 8 + m]
                out.append((kind, body))
                if kind == MORE:
                    blocks.append(struct.unpack("<QQ", body[:16]))
                k += 8 + m
        return out

    def tree(self, address: int, key: int, rows: tuple[int, int] | None = None) -> Iterator[tuple[bytes, int]]:
        """(key, child) of the leaves of a tree whose keys are ``key`` bytes long. ``rows`` (begin,
        end, the begin of a chunk): of a tree of chunks only the branches that can hold these; keys are in order."""
        head = self.read(address, 24)
        if head[:4] != b"TREE":
            raise ValueError("no tree")
        level, n = head[5], struct.unpack_from("<H", head, 6)[0]
        data = self.read(address + 24, n * (key + 8) + key)
        for i in range(n):
            at = i * (key + 8)
            if rows and (struct.unpack_from("<Q", data, at + 8)[0] >= rows[1] or (level and struct.unpack_from("<Q", data, at + key + 16)[0] < rows[0])):
                continue
            child = struct.unpack_from("<Q", data, at + key)[0]
            if level:
                yield from self.tree(child, key, rows)
            else:
                yield data[at : at + key], child

    def members(self, address: int) -> dict[str, int]:
        """Names in a group, and where their headers are."""
        if address not in self.groups:
            table = next((b for k, b in self.messages(address) if k == NAMES), None)
            if table is None:
                raise KeyError("no group")
            tree, heap = struct.unpack("<QQ", table[:16])
            size, _, data = struct.unpack("<QQQ", self.read(heap + 8, 24))
            names, own = self.read(data, size), {}
            for _, node in self.tree(tree, 8):
                (n,) = struct.unpack("<H", self.read(node + 6, 2))
                rows = self.read(node + 8, 40 * n)
                for i in range(n):
                    name, header = struct.unpack_from("<QQ", rows, 40 * i)
                    own[names[name : names.index(b"\0", name)].decode()] = header
            self.groups[address] = own
        return self.groups[address]

    def find(self, path: str) -> int:
        at = self.root
        for part in path.strip("/").split("/") if path.strip("/") else ():
            at = self.members(at)[part]
        return at

    def array(self, path: str) -> Array:
        a = Array()
        for kind, b in self.messages(self.find(path)):
            if kind == SPACE:
                a.shape = struct.unpack_from(f"<{b[1]}Q", b, 8 if b[0] == 1 else 4)
            elif kind == KIND:
                a.kind = _number(b)
            elif kind == LAYOUT:
                if b[0] != 3:
                    raise ValueError("a layout of another version")
                if b[1] == 0:
                    a.layout = ("here", b[4 : 4 + struct.unpack_from("<H", b, 2)[0]])
                elif b[1] == 1:
                    a.layout = ("piece", *struct.unpack_from("<QQ", b, 2))
                else:
                    a.layout = ("chunks", struct.unpack_from("<Q", b, 3)[0], struct.unpack_from(f"<{b[2]}I", b, 11)[:-1])
            elif kind == FILTERS:
                a.filters = _filters(b)
        if not a.layout:
            raise KeyError(path)
        return a

    def picked(self, path: str, wanted: list[int]) -> Iterator[tuple[int, np.ndarray]]:
        """(row, values) of those of the wanted rows (in order) that are there. The header and the
        branches of the tree are read once, each chunk once, and only chunks with a wanted row."""
        a = self.array(path)
        if a.kind is None or not a.shape:
            raise IndexError(f"no rows in {path}")
        wanted = [r for r in wanted if 0 <= r < a.shape[0]]
        if not wanted:
            return
        if a.layout[0] != "chunks":
            for r in wanted:
                yield r, self.rows(path, r, r + 1, a)[0]
            return
        _, root, chunk = a.layout
        bands: dict[int, list[tuple[bytes, int]]] = {}
        for key, place in self.tree(root, 8 + 8 * (len(chunk) + 1), (wanted[0] - wanted[0] % chunk[0], wanted[-1] + 1)) if root != NOWHERE else ():
            bands.setdefault(struct.unpack_from("<Q", key, 8)[0], []).append((key, place))
        band, part = None, None
        for r in wanted:
            begin = r - r % chunk[0]
            if begin != band:
                band, part = begin, self.rows(path, begin, min(begin + chunk[0], a.shape[0]), a, bands.get(begin, []))
            yield r, part[r - begin]

    def rows(self, path: str, begin: int, end: int, a: Array | None = None, chunks: list[tuple[bytes, int]] | None = None) -> np.ndarray:
        """Rows ``begin`` to ``end`` of an array; of a chunked one only the chunks that hold them.
        The array's header and those chunks may be given."""
        a = a or self.array(path)
        if a.kind is None or not a.shape or not 0 <= begin <= end <= a.shape[0]:
            raise IndexError(f"no rows {begin} to {end} of {path}")
        shape = (end - begin, *a.shape[1:])
        row = int(np.prod(a.shape[1:], dtype=np.int64)) * a.kind.itemsize
        if a.layout[0] == "here":
            return np.frombuffer(a.layout[1], a.kind)[begin * row // a.kind.itemsize : end * row // a.kind.itemsize].reshape(shape)
        if a.layout[0] == "piece":
            data = self.read(a.layout[1] + begin * row, shape[0] * row) if a.layout[1] != NOWHERE else bytes(shape[0] * row)
            return np.frombuffer(data, a.kind).reshape(shape)
        out = np.zeros(shape, a.kind)
        _, root, chunk = a.layout
        if chunks is None:
            chunks = self.tree(root, 8 + 8 * (len(chunk) + 1), (begin - begin % chunk[0], end)) if root != NOWHERE else ()
        for key, place in chunks:
            size, skipped, *at = struct.unpack(f"<II{len(chunk) + 1}Q", key)
            lo, hi = max(begin, at[0]), min(end, at[0] + chunk[0])
            if lo >= hi:
                continue
            data = _unfiltered(self.read(place, size), a, skipped)
            part = np.frombuffer(data, a.kind, int(np.prod(chunk))).reshape(chunk)
            inner = [slice(o, min(o + c, n)) for o, c, n in zip(at[1:], chunk[1:], a.shape[1:], strict=False)]
            out[(slice(lo - begin, hi - begin), *inner)] = part[(slice(lo - at[0], hi - at[0]), *[slice(0, s.stop - s.start) for s in inner])]
        return out

    def text(self, path: str) -> str:
        """The single text of an array without dimensions."""
        a = self.array(path)
        size = 16 if a.kind is None else a.kind.itemsize
        data = a.layout[1][:size] if a.layout[0] == "here" else self.read(a.layout[1], size)
        if a.kind is None:
            n, heap, index = struct.unpack("<IQI", data)
            return self.heap(heap, index)[:n].decode()
        if a.kind.kind != "S":
            raise KeyError(path)
        return data.rstrip(b"\0").decode()

    def heap(self, address: int, index: int) -> bytes:
        head = self.read(address, 16)
        if head[:4] != b"GCOL":
            raise ValueError("no heap")
        data, at = self.read(address, struct.unpack_from("<Q", head, 8)[0]), 16
        while at + 16 <= len(data):
            own, size = struct.unpack_from("<H6xQ", data, at)
            if own == index:
                return data[at + 16 : at + 16 + size]
            if not own:
                break
            at += 16 + -(-size // 8) * 8
        raise KeyError(index)


def _number(b: bytes) -> np.dtype | None:
    """The kind of an array's values."""
    what, bits, size = b[0] & 15, b[1], struct.unpack_from("<I", b, 4)[0]
    order = ">" if bits & 1 else "<"
    if what == 0:
        return np.dtype(f"{order}{'i' if bits & 8 else 'u'}{size}")
    if what == 1:
        return np.dtype(f"{order}f{size}")
    if what == 3:
        return np.dtype(f"S{size}")
    if what == 9 and bits & 15 == 1:
        return None
    raise ValueError(f"values of class {what} aren't read")


def _filters(b: bytes) -> list[tuple[int, tuple[int, ...]]]:
    out, at = [], 8 if b[0] == 1 else 2
    for _ in range(b[1]):
        (kind,) = struct.unpack_from("<H", b, at)
        named = b[0] == 1 or kind >= 256
        name = struct.unpack_from("<H", b, at + 2)[0] if named else 0
        at += 4 if named else 2
        _, n = struct.unpack_from("<HH", b, at)
        at += 4 + (-(-name // 8) * 8 if b[0] == 1 else name)
        out.append((kind, struct.unpack_from(f"<{n}I", b, at)))
        at += 4 * n + (4 if b[0] == 1 and n % 2 else 0)
    return out


def _unfiltered(data: bytes, a: Array, skipped: int) -> bytes:
    for i, (kind, _) in reversed(list(enumerate(a.filters))):
        if skipped >> i & 1:
            continue
        if kind == DEFLATE:
            data = zlib.decompress(data)
        elif kind == SHUFFLE:
            n = len(data) // a.kind.itemsize
            data = np.frombuffer(data, np.uint8)[: n * a.kind.itemsize].reshape(a.kind.itemsize, n).T.tobytes() + data[n * a.kind.itemsize :]
        elif kind == CHECKSUM:
            data = data[:-4]
        else:
            raise ValueError(f"filter {kind} isn't known")
    return data


# -- writing -------------------------------------------------------------------


def _message(kind: int, body: bytes) -> bytes:
    body += bytes(-len(body) % 8)
    return struct.pack("<HHB3x", kind, len(body), 0) + body


class Writer:
    """A file of groups, arrays in chunks and texts, built in memory."""

    def __init__(self):
        self.data = bytearray(96)

    def add(self, content: bytes) -> int:
        self.data += bytes(-len(self.data) % 8)
        self.data += content
        return len(self.data) - len(content)

    def header(self, *messages: bytes) -> int:
        return self.add(struct.pack("<BxHII4x", 1, len(messages), 1, sum(map(len, messages))) + b"".join(messages))

    def array(self, values: np.ndarray, chunk: tuple[int, ...], shuffle: bool = True) -> int:
        kind, rank = values.dtype.newbyteorder("<"), values.ndim
        places = []
        for at in np.ndindex(*[-(-n // c) for n, c in zip(values.shape, chunk, strict=True)]):
            begin = [i * c for i, c in zip(at, chunk, strict=True)]
            part = np.zeros(chunk, kind)
            own = values[tuple(slice(b, b + c) for b, c in zip(begin, chunk, strict=True))]
            part[tuple(slice(0, n) for n in own.shape)] = own
            raw = part.tobytes()
            if shuffle:
                raw = np.frombuffer(raw, np.uint8).reshape(-1, kind.itemsize).T.tobytes()
            packed = zlib.compress(raw)
            places.append((struct.pack(f"<II{rank + 1}Q", len(packed), 0, *begin, 0), self.add(packed)))
        tree = self.tree(1, places, struct.pack(f"<II{rank + 1}Q", 0, 0, *values.shape, 0)) if places else NOWHERE
        if kind.kind == "f":
            exponent, mantissa, bias = {2: (5, 10, 15), 4: (8, 23, 127), 8: (11, 52, 1023)}[kind.itemsize]
            what = struct.pack("<BBBBIHHBBBBI", 0x11, 0x20, kind.itemsize * 8 - 1, 0, kind.itemsize, 0, kind.itemsize * 8, mantissa, exponent, 0, mantissa, bias)
        else:
            what = struct.pack("<BBBBIHH", 0x10, 8 * (kind.kind == "i"), 0, 0, kind.itemsize, 0, kind.itemsize * 8)
        filters = ([(SHUFFLE, (kind.itemsize,))] if shuffle else []) + [(DEFLATE, (6,))]
        pipe = struct.pack("<BB6x", 1, len(filters)) + b"".join(struct.pack("<HHHHII", k, 0, 1, 1, v[0], 0) for k, v in filters)
        layout = struct.pack(f"<BBBQ{rank + 1}I", 3, 2, rank + 1, tree, *chunk, kind.itemsize)
        return self.header(_message(SPACE, struct.pack(f"<BBB5x{rank}Q", 1, rank, 0, *values.shape)), _message(KIND, what), _message(LAYOUT, layout), _message(FILTERS, pipe))

    def text(self, value: str) -> int:
        raw = value.encode()
        body = struct.pack("<HH4xQ", 1, 1, len(raw)) + raw + bytes(-len(raw) % 8) + bytes(16)
        heap = self.add(b"GCOL" + struct.pack("<B3xQ", 1, 16 + len(body)) + body)
        place = self.add(struct.pack("<IQI", len(raw), heap, 1))
        kind = struct.pack("<BBBBI", 0x19, 1, 1, 0, 16) + struct.pack("<BBBBI", 0x13, 0, 0, 0, 1)
        return self.header(_message(SPACE, struct.pack("<BBB5x", 1, 0, 0)), _message(KIND, kind), _message(LAYOUT, struct.pack("<BBQQ", 3, 1, place, 16)))

    def tree(self, kind: int, entries: list[tuple[bytes, int]], end: bytes, level: int = 0) -> int:
        """A tree of (key, child), at most 64 to a node."""
        nodes = []
        for k in range(0, len(entries), 64):
            part = entries[k : k + 64]
            body = b"".join(key + struct.pack("<Q", child) for key, child in part) + (entries[k + 64][0] if k + 64 < len(entries) else end)
            nodes.append((part[0][0], self.add(b"TREE" + struct.pack("<BBHQQ", kind, level, len(part), NOWHERE, NOWHERE) + body)))
        return nodes[0][1] if len(nodes) == 1 else self.tree(kind, nodes, end, level + 1)

    def group(self, members: dict[str, int]) -> int:
        names, at = bytearray(8), {}
        for name in sorted(members):
            at[name] = len(names)
            names += name.encode() + b"\0"
            names += bytes(-len(names) % 8)
        heap = self.add(b"HEAP" + struct.pack("<B3xQQQ", 0, len(names), NOWHERE, self.add(bytes(names))))
        order, nodes = sorted(members), []
        for k in range(0, max(1, len(order)), 8):
            rows = b"".join(struct.pack("<QQI4x16x", at[n], members[n], 0) for n in order[k : k + 8])
            node = self.add(b"SNOD" + struct.pack("<BxH", 1, len(order[k : k + 8])) + rows + bytes(40 * (8 - len(order[k : k + 8]))))
            nodes.append((struct.pack("<Q", at[order[k - 1]] if k else 0), node))
        end = struct.pack("<Q", at[order[-1]] if order else 0)
        return self.header(_message(NAMES, struct.pack("<QQ", self.tree(0, nodes, end), heap)))

    def finish(self, root: int) -> bytes:
        self.data[:96] = MAGIC + struct.pack("<8B", 0, 0, 0, 0, 0, 8, 8, 0) + struct.pack("<HHI", 4, 32, 0) + struct.pack("<QQQQ", 0, NOWHERE, len(self.data), NOWHERE) + struct.pack("<QQI4x16x", 0, root, 0)
        return bytes(self.data)


# -- tables --------------------------------------------------------------------

_BROKEN = (ValueError, KeyError, IndexError, struct.error, zlib.error, UnicodeDecodeError)


def _listing(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{h5,hdf5}").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.substring_index("path", "/", -1).alias("file"))


def read_depth(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """Depth of wanted frames: rows (file, key, row, unit) name an array, a row of it and by what
    its values are divided (1 for metres, 1000 for millimetres). Gives file, key, row, height, width,
    depth; what isn't there gives no row. A task reads the wanted rows of BLOCK_ROWS rows of an
    array at a time, each chunk of them once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(name: str, key: str, held: list) -> pa.RecordBatch:
            n = len(held)
            shape = [pa.array([d.shape[i] for _, d in held], pa.int32()) for i in range(2)]
            return pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array([key] * n), pa.array([r for r, _ in held], pa.int64()), *shape, pa.array([d.ravel() for _, d in held], pa.list_(pa.float32()))], ["file", "key", "row", "height", "width", "depth"])

        for b in batches:
            for path, name, key, items in zip(*[c.to_pylist() for c in b.columns], strict=True):
                f, held = File(ranged(path)[0]), []
                units: dict[int, list[float]] = {}
                for x in items:
                    units.setdefault(x["row"], []).append(x["unit"])
                try:
                    for row, v in f.picked(key, sorted(units)):
                        held += [(row, v.astype(np.float32) / np.float32(u)) for u in units[row]]
                        if len(held) * held[0][1].nbytes >= BATCH_BYTES:
                            yield sent(name, key, held)
                            held = []
                except (KeyError, IndexError):
                    continue
                if held:
                    yield sent(name, key, held)

    row = F.col("row").cast("long")
    own = wanted.groupBy("file", "key", F.floor(row / BLOCK_ROWS).alias("block")).agg(F.collect_set(F.struct(row.alias("row"), F.col("unit").cast("double").alias("unit"))).alias("items"))
    found = _listing(spark, folder).join(own, "file").select("path", "file", "key", "items")
    return found.mapInArrow(run, "file string, key string, row long, height int, width int, depth array<float>")


def read_texts(spark: SparkSession, folder: str, prefix: str, member: str) -> DataFrame:
    """(file, name, text): the text ``member`` of each group whose name begins with ``prefix``.
    A group without it, or with something else there, and a broken file are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, name in zip(*[c.to_pylist() for c in b.columns], strict=True):
                try:
                    f = File(ranged(path)[0])
                    groups = sorted(n for n in f.members(f.root) if n.startswith(prefix))
                except _BROKEN:
                    continue
                for g in groups:
                    try:
                        rows.append((name, g, f.text(f"{g}/{member}")))
                    except _BROKEN:
                        continue
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["file", "name", "text"])

    return _listing(spark, folder).mapInArrow(run, "file string, name string, text string")
