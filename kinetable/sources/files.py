"""Files as rows: a sink for contents made by tasks, and facts and pieces of files of any store.

Contents are read by Spark's ``binaryFile``; what has to be opened besides (lists, sizes, byte
ranges, marks) goes through Hadoop's file systems, so every store that Spark knows will do."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .stores import inside, put, store


class Done(WriterCommitMessage):
    pass


class BlobWriter(DataSourceWriter):
    """Writes each row (path, content) as a file below the folder, in whatever store it is: beside
    its place first and then moved there, so that a file is whole or not there and a task may run
    again."""

    def __init__(self, options: dict):
        self.root = options["path"]
        store(self.root)  # an unknown store is an error before any row is made

    def write(self, rows: Iterator) -> WriterCommitMessage:
        for r in rows:
            put(inside(self.root, r["path"]), bytes(r["content"]))
        return Done()


class BlobSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blobs"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return BlobWriter(self.options)


def write_files(df: DataFrame, folder: str) -> str:
    """Write rows (path, content) as files of a folder that all executors see."""
    df.sparkSession.dataSource.register(BlobSink)
    df.select("path", "content").write.format("blobs").mode("append").save(folder)
    return folder


def file_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Table]]:
    """(file, its rows) of batches that are in order of their column ``file``."""
    name, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        runs = pc.run_end_encode(b.column("file"))
        begin = 0
        for own, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
            if held and own != name:
                yield name, pa.Table.from_batches(held)
                held = []
            name = own
            held.append(b.slice(begin, end - begin))
            begin = end
    if held:
        yield name, pa.Table.from_batches(held)


def write_made(rows: DataFrame, folder: str, make: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[str, bytes]]]) -> str:
    """Write the files (path, content) that ``make`` gives of the rows, one at a time in the task that
    makes them: contents go to no other process, and a task holds one, however many it makes."""
    store(folder)  # an unknown store is an error before any row is made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for path, content in make(batches):
            put(inside(folder, path), content)
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    rows.mapInArrow(run, "n long").write.format("noop").mode("append").save()
    return folder


def write_grouped(rows: DataFrame, folder: str, build: Callable[[pa.Table], bytes]) -> str:
    """Write what ``build`` makes of the rows of each ``file``, a file each. Rows meet by a sort, so a
    task has a batch and one file's rows at a time, and many small files cost no group each."""
    sorted_ = rows.repartition("file").sortWithinPartitions("file")
    return write_made(sorted_, folder, lambda batches: ((name, build(group)) for name, group in file_groups(batches)))


def retried(call: Callable, attempts: int = 3, wait: float = 0.2):
    """The result of a call that may fail and is then tried again, after a longer wait each time."""
    for k in range(attempts):
        try:
            return call()
        except Exception:
            if k == attempts - 1:
                raise
            time.sleep(wait * 2**k)


def _place(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _place(spark, path)
    return retried(lambda: fs.exists(p))


def size_of(spark: SparkSession, path: str) -> int:
    fs, p = _place(spark, path)
    return retried(lambda: fs.getContentSummary(p).getLength())


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, in order."""
    fs, p = _place(spark, pattern)
    return sorted(s.getPath().toString() for s in retried(lambda: fs.globStatus(p)) or [])


def byte_range(spark: SparkSession, path: str, begin: int, n: int) -> bytes:
    """n bytes of a file from ``begin``."""
    fs, p = _place(spark, path)

    def read() -> bytes:
        stream = fs.open(p)
        try:
            stream.seek(begin)
            return bytes(b & 255 for b in stream.readNBytes(n))
        finally:
            stream.close()

    return retried(read)


def write_json(spark: SparkSession, path: str, value) -> None:
    """One JSON file, written beside its place and then renamed over what was there, so that a reader
    sees the old file or the new one."""
    fs, p = _place(spark, path)
    content = json.dumps(value, sort_keys=True).encode()
    if fs.getUri().getScheme() == "file":
        fs.delete(fs.getChecksumFile(p), False)  # of an older writer
        put(fs.makeQualified(p).toUri().getPath(), content)
        return
    _, part = _place(spark, path + ".part")
    out = fs.create(part, True)
    out.write(bytearray(content))
    out.close()
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsparkSession.sessionState().newHadoopConf())
    kinds = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    kinds[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(part), fs.makeQualified(p), kinds)


def write_summary(spark: SparkSession, folder: str, summary: dict, complete: bool) -> None:
    """A summary, and the mark DONE once everything is there; an older mark goes otherwise."""
    write_json(spark, f"{folder}/summary.json", summary)
    if complete:
        write_json(spark, f"{folder}/DONE", True)
    else:
        fs, p = _place(spark, f"{folder}/DONE")
        fs.delete(p, False)


def fetched_once(spark: SparkSession, source: str, target: str, unpack: Callable[[bytes], Iterator[tuple[str, bytes]]]) -> bool:
    """Copy the members of an archive into a folder unless its mark is there; whether it was done."""
    if exists(spark, f"{target}/_DONE"):
        return False
    whole = spark.read.format("binaryFile").load(source).select("content").first()["content"]
    rows = [(name, bytearray(data)) for name, data in unpack(bytes(whole))]
    write_files(spark.createDataFrame(rows, "path string, content binary"), target)
    write_json(spark, f"{target}/_DONE", True)
    return True


def directory(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path below the folder, length) of all files, without reading them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    root = folder.rstrip("/").removeprefix("file://").removeprefix("file:")
    return files.select(F.expr("substring_index(path, '{}/', -1)".format(root.replace("'", "''"))).alias("path"), "length")
