"""What the operators of this subpackage share: reading, shipping code, shared storage."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()

#: Text that one step of a Python loop holds at once, in bytes (one text may be longer).
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Make this package importable on executors and keep Arrow batches small.

    The package is added to the job as one zip file, once per application, so a
    cluster needs no installation. Arrow batches default to 10,000 rows, which is
    too much memory for a worker when texts are long.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        name = os.path.join(tempfile.mkdtemp(), "kinetable.zip")
        with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
            for top, _, files in os.walk(root):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(top, f)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        sc.addPyFile(name)
        _SHIPPED.add(sc.applicationId)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) >= 10000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (spark.checkpoint.dir)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame, name: str = "step", few: bool = False, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back; ``few``: in at most four
    files for each core of the cluster, for tables of ids and counts; ``by``: the last columns, a
    folder for each of their few values.

    It cuts the lineage as checkpoint() does, but the files are columnar and
    compressed, and a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.coalesce(4 * spark.sparkContext.defaultParallelism) if few else df).write.partitionBy(*by or []).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    for made in _SCRATCH:
        made.append(out)
    return out


_SCRATCH: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """The list of what ``materialize`` writes inside."""
    _SCRATCH.append(made := [])
    try:
        yield made
    finally:
        _SCRATCH.remove(made)


def discard(*written: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more."""
    for df in written:
        jvm = df.sparkSession.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(df.written_at)
        place.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


#: How to empty the caches that this process holds, by name.
_CACHES: dict[str, Callable[[], None]] = {}


def cached(name: str, clear: Callable[[], None]) -> None:
    """Say that this process now holds a cache; tasks that don't use it empty it."""
    _CACHES[name] = clear


def release(keep: str = "") -> None:
    """Empty the caches but one, and give freed memory back to the system."""
    for name in [n for n in _CACHES if n != keep]:
        _CACHES.pop(name)()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def frugal(run: Callable, keep: str = "") -> Callable:
    """A function of batches whose worker gives memory back at the end of the task, and at its
    begin empties the caches of other operators (all but ``keep``): workers serve task after
    task, of one operator after the other, and would else keep the most that any of them took."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(keep)
        try:
            yield from run(batches)
        finally:
            release(keep)

    return wrapped


def text_groups(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_pylist()
        first, held = 0, 0
        for i, n in enumerate(sizes):
            held += n
            if held >= limit:
                yield batch.slice(first, i + 1 - first)
                first, held = i + 1, 0
        if first < batch.num_rows:
            yield batch.slice(first)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts, with null as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


#: Rows of (id, key) that may be broadcast: about 16 MB for two longs a row.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if a count shows that it has at most ``rows`` rows;
    beyond that it is joined by a shuffle. For narrow tables of ids and keys."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: A group is hot if it has more than one in so many of all rows; so there are fewer than that.
HOT_GROUPS = 1024


def with_groups(rows: DataFrame, groups: DataFrame, on: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with the row of their group (written ``groups``: one row a key, ``n`` rows
    in the group). Hot groups are fewer than HOT_GROUPS, so they are broadcast, and none of
    them meets in one task; the others are joined by a shuffle."""
    hot = groups.where(F.col(n) * HOT_GROUPS > total)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(groups.where(F.col(n) * HOT_GROUPS <= total), on, how)
    return rows.join(F.broadcast(hot), on).unionByName(rest)
