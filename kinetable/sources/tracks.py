"""Track archives (NPZ): contents as rows and back.

Arrays of points are either of one object, points by frames by two or three, or a dictionary
of such by object. Rows are long: file, obj, point_id, frame, x, y, z, visible (and object_id
where the archive has one for each point); a coordinate that isn't a number is null, and
without a visibility array a point is visible where all its coordinates are numbers.

Reading is a scan of Spark's ``binaryFile`` and an Arrow function, so archives may lie in any
store. Dictionaries are pickled in such archives; only numpy's own types are unpickled.
"""

from __future__ import annotations

import io
import pickle
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .files import BlobWriter, write_files, write_grouped
from .stores import store

SCHEMA = "file string, obj string, point_id int, frame int, x float, y float, z float, visible boolean, object_id int"
_KINDS = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float32(), pa.float32(), pa.float32(), pa.bool_(), pa.int32()]
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
FLAT = "__flat__"
#: What a pickled array of numpy refers to (fixed values).
NUMPY = {(m, n) for m in ("numpy._core.multiarray", "numpy.core.multiarray") for n in ("_reconstruct", "scalar")} | {("numpy", "ndarray"), ("numpy", "dtype"), ("numpy._core.numeric", "_frombuffer"), ("numpy.core.numeric", "_frombuffer")}


class _Plain(pickle.Unpickler):
    def find_class(self, module: str, name: str):
        if (module, name) not in NUMPY:
            raise pickle.UnpicklingError(f"{module}.{name} isn't allowed in an archive")
        return super().find_class(module, name)


def load_archive(content: bytes) -> dict[str, np.ndarray]:
    """Arrays of an archive by name, without running code that it holds."""
    out = {}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in z.namelist():
            f = io.BytesIO(z.read(name))
            version = np.lib.format.read_magic(f)
            header = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
            _, _, dtype = header(f)
            if dtype.hasobject:
                out[name.removesuffix(".npy")] = _Plain(f).load()
            else:
                f.seek(0)
                out[name.removesuffix(".npy")] = np.lib.format.read_array(f, allow_pickle=False)
    return out


def track_batch(file: str, obj: str, p: np.ndarray, seen: np.ndarray | None, layout: str = "ntc", stride: int = 1, object_ids: np.ndarray | None = None) -> pa.RecordBatch:
    p = np.asarray(p, np.float32)
    if layout == "tnc":
        p = p.transpose(1, 0, 2)
    ok = np.isfinite(p).all(2)
    if seen is not None:
        seen = np.asarray(seen)
        if seen.ndim == 3:
            seen = seen[..., 0]
        ok &= (seen.T if layout == "tnc" else seen) > 0.5
    p, ok = p[:, ::stride], ok[:, ::stride]
    n, t = ok.shape
    xyz = [pa.array(p[..., k].ravel(), mask=~np.isfinite(p[..., k].ravel())) if k < p.shape[2] else pa.nulls(n * t, pa.float32()) for k in range(3)]
    ids = pa.array(np.repeat(np.asarray(object_ids, np.int32), t)) if object_ids is not None else pa.nulls(n * t, pa.int32())
    cols = [pa.repeat(pa.scalar(v, pa.string()), n * t) for v in (file, obj)] + [pa.array(v.astype(np.int32)) for v in (np.repeat(np.arange(n), t), np.tile(np.arange(t), n))]
    cols += [*xyz, pa.array(ok.ravel()), ids]
    return pa.RecordBatch.from_arrays(cols, _NAMES)


def archive_batches(file: str, content: bytes, points: str = "points_3d", visible: str = "visibility", layout: str = "ntc", stride: int = 1) -> Iterator[pa.RecordBatch]:
    z = load_archive(content)
    if points not in z:  # missing, as a file that isn't there
        return
    p, seen, ids = z[points], z.get(visible), z.get("object_ids")
    if p.dtype == object:
        p, seen = p.item(), seen.item() if seen is not None else {}
    else:
        p, seen = {FLAT: p}, {FLAT: seen} if seen is not None else {}
    for obj in sorted(p):
        yield track_batch(file, obj, p[obj], seen.get(obj), layout, stride, ids if len(p) == 1 else None)


def joined(batches: Iterator[pa.RecordBatch], rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least so many, but for the last: small archives cost no batch each."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def read_tracks(spark: SparkSession, folder: str, pattern: str = "*.npz", **options) -> DataFrame:
    """Rows of all archives of a folder; options as of ``archive_batches``."""

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):  # a content at a time
                yield from archive_batches(path.as_py().rpartition("/")[2], content.as_py(), **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from joined(every(batches))

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").mapInArrow(run, SCHEMA)


def archive_shapes(spark: SparkSession, folder: str, points: str = "points_3d") -> DataFrame:
    """(file, n_points, n_frames) from the headers alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(points + ".npy") as f:
                    np.lib.format.read_magic(f)
                    shape, _, _ = np.lib.format.read_array_header_1_0(f)
                    rows.append((path.rpartition("/")[2], shape[0], shape[1]) if len(shape) == 3 else (path.rpartition("/")[2], None, None))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["file", "n_points", "n_frames"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").mapInArrow(run, "file string, n_points long, n_frames long")


def archive_bytes(objects: dict[str, dict[str, np.ndarray]], points: str, visible: str | None, layout: str, dims: int, extra: dict | None = None) -> bytes:
    """An archive of arrays by object: columns point_id, frame, x, y, z, visible; ``extra``: further
    arrays by name."""
    p, seen = {}, {}
    for obj, c in objects.items():
        i, j = c["point_id"], c["frame"]
        shape = int(i.max()) + 1, int(j.max()) + 1
        p[obj], seen[obj] = np.full((*shape, dims), np.nan, np.float32), np.zeros(shape, bool)
        p[obj][i, j] = np.stack([c[k] for k in ("x", "y", "z")[:dims]], 1)
        seen[obj][i, j] = c["visible"]
        if layout == "tnc":
            p[obj], seen[obj] = p[obj].transpose(1, 0, 2), seen[obj].T
    flat = list(p) == [FLAT]
    arrays = {k: np.asarray(v) for k, v in (extra or {}).items()} | {points: p[FLAT] if flat else np.array(p, object)}
    if visible:
        arrays[visible] = seen[FLAT] if flat else np.array(seen, object)
    first = next(iter(objects.values()))
    if flat and "object_id" in first:
        ids = np.zeros(int(first["point_id"].max()) + 1, np.int32)
        ids[first["point_id"]] = first["object_id"]
        arrays["object_ids"] = ids
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def write_tracks(df: DataFrame, folder: str, points: str = "points_3d", visible: str | None = "visibility", layout: str = "ntc", dims: int = 3, extra: dict | None = None) -> str:
    """Long rows (file, obj, point_id, frame, x, y[, z], visible[, object_id]) as an archive a file;
    ``extra``: further arrays, the same in each."""
    names = [c for c in (*_NAMES,) if c in df.columns]

    def build(group: pa.Table) -> bytes:
        cols = {c: group[c].to_numpy() for c in names if c not in ("file", "obj")}
        for c in ("x", "y", "z"):
            if c in cols:
                cols[c] = cols[c].astype(float)
        obj = np.array(group["obj"].to_pylist(), object)
        objects = {o: {c: v[obj == o] for c, v in cols.items()} for o in sorted(set(obj.tolist()))}
        return archive_bytes(objects, points, visible, layout, dims, extra)

    return write_grouped(df.select(*names), folder, build)


class Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


class TrackReader(DataSourceReader):
    """``spark.read.format("tracks").load(folder)``: archives of a folder of any known store, one a
    partition. Options: ``layout``, ``stride``, ``points``, ``visible``."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.options = {"layout": options.get("layout", "ntc"), "stride": int(options.get("stride", "1")), "points": options.get("points", "points_3d"), "visible": options.get("visible", "visibility")}

    def partitions(self) -> list[InputPartition]:
        files, root = store(self.root)
        return [Archive(i.path) for i in sorted(files.get_file_info(FileSelector(root, recursive=True)), key=lambda i: i.path) if i.path.endswith(".npz")]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        with store(self.root)[0].open_input_file(partition.path) as f:
            yield from archive_batches(partition.path.rpartition("/")[2], f.read(), **self.options)


class TrackWriter(DataSourceWriter):
    """Writes rows of one file as an archive; rows of a file must come to one task. An archive is
    written beside its place and then moved there."""

    def __init__(self, options: dict):
        self.files = BlobWriter(options)

    def write(self, rows: Iterator) -> WriterCommitMessage:
        held: dict[str, dict[str, list]] = {}
        for r in rows:
            held.setdefault(r["file"], {}).setdefault(r["obj"], []).append((r["point_id"], r["frame"], r["x"], r["y"], r["z"], r["visible"]))
        out = []
        for file, objects in held.items():
            a = {o: np.array([[np.nan if x is None else x for x in row] for row in v], float) for o, v in objects.items()}
            cols = {o: {"point_id": v[:, 0].astype(int), "frame": v[:, 1].astype(int), "x": v[:, 2], "y": v[:, 3], "z": v[:, 4], "visible": v[:, 5] > 0} for o, v in a.items()}
            out.append({"path": file, "content": archive_bytes(cols, "points_3d", "visibility", "ntc", 3)})
        return self.files.write(out)


class TrackSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tracks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TrackReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return TrackWriter(self.options)


def register(spark) -> None:
    spark.dataSource.register(TrackSource)


def write_arrays(df: DataFrame, folder: str, name: str, values: str, width: int) -> str:
    """An NPY file a row, from a flat array of numbers in rows of ``width``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v in b.column(1).to_pylist():
                held = io.BytesIO()
                np.save(held, np.asarray(v, float).reshape(-1, width), allow_pickle=False)
                out.append(held.getvalue())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["path", "content"])

    return write_files(df.select(name, values).mapInArrow(run, "path string, content binary"), folder)


def read_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """(file, shape, values) of NPY files of numbers; pickled ones are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = [np.load(io.BytesIO(c), allow_pickle=False) for c in b.column(1).to_pylist()]
            names = [x.rpartition("/")[2] for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([list(a.shape) for a in every], pa.list_(pa.int64())), pa.array([a.ravel().astype(float) for a in every], pa.list_(pa.float64()))], ["file", "shape", "values"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").mapInArrow(run, "file string, shape array<long>, values array<double>")
