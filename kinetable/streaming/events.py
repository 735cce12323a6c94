"""Streams of events. Event-time windows and de-duplication are features of this engine; the
packer is a stateful operator that holds a bounded buffer for each shard.

A stream is read from a folder of Parquet files, all that are there (availableNow), and its
result is a table, so a query runs the same in a batch job and as a running stream; with a
checkpoint folder it goes on where it stopped.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.packing import BufferedPacker, as_limits
from ..sources.files import exists, listed
from ..storage import new_folder
from ..tables import SCHEMAS


#: The store of state that keeps lists and timers, and the setting that names it.
STORE = "spark.sql.streaming.stateStore.providerClass"
LISTS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def keeping_lists(spark: SparkSession) -> Iterator[None]:
    """State with lists and timers inside; the session's own setting comes back afterwards."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, LISTS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def read_stream(spark: SparkSession, folder: str, name: str = "events", files_per_trigger: int = 1) -> DataFrame:
    """A folder of a table's Parquet files as a stream; times are instants (UTC)."""
    df = spark.readStream.schema(SCHEMAS[name]).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(folder)
    for f in df.schema:
        if f.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return df


def table_of(df: DataFrame, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is there and return its result: a Parquet folder a batch, which a
    batch that runs again writes again. In mode ``complete`` the last batch is the result."""
    spark = df.sparkSession
    out = new_folder(spark, "stream")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with keeping_lists(spark):
        q = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or new_folder(spark, "marks")).trigger(availableNow=True).foreachBatch(put).start()
        q.awaitTermination()
    numbers = sorted(int(p.rpartition("=")[2]) for p in listed(spark, f"{out}/batch=*"))
    if not numbers:
        return spark.createDataFrame([], df.schema)
    wanted = numbers[-1:] if mode == "complete" else numbers
    return spark.read.schema(df.schema).parquet(*[f"{out}/batch={n}" for n in wanted])


def append_to(df: DataFrame, path: str, checkpoint: str) -> None:
    """Append a stream's rows to a folder of Parquet files, each row once."""
    with keeping_lists(df.sparkSession):
        df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def tumbling_counts(events: DataFrame, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n")


def deduplicated(events: DataFrame, key: list[str], late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


class Packer(StatefulProcessor):
    """The packer of one shard. State: ``held`` (list of the rows that wait), ``bins`` (bins that
    have left) and ``last`` (the largest key seen), each a readable table of its own. With
    ``growing``, keys of a shard grow from batch to batch like offsets of a source, so a row at or
    below ``last`` is one that was read before and is left out; that way a source may begin again
    anywhere. If ``idle`` is given, a shard without rows for so many milliseconds lets go of what
    waits."""

    def __init__(self, limits: tuple, buffer: int, idle: int | None, growing: bool):
        self.limits, self.buffer, self.idle, self.growing = as_limits(limits), buffer, idle, growing

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "key long, a long, b long")
        self.bins = handle.getValueState("bins", "n long")
        self.last = handle.getValueState("last", "key long")

    def _out(self, shard: int, bins: list[list]) -> pd.DataFrame:
        n = self.bins.get()[0] if self.bins.exists() else 0
        rows = [(shard, n + k, i, *x) for k, items in enumerate(bins) for i, x in enumerate(items)]
        self.bins.update((n + len(bins),))
        return pd.DataFrame(rows, columns=["shard", "bin", "place", "key", "a", "b"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True).sort_values("key")[["key", "a", "b"]]  # one batch of one shard, three numbers a row
        last = self.last.get()[0] if self.last.exists() else None
        if self.growing:
            new = new.drop_duplicates("key")
            new = new if last is None else new[new["key"] > last]
        if len(new):
            p = BufferedPacker(self.limits, self.buffer, [tuple(x) for x in self.held.get()])
            bins = [items for x in zip(*[new[c].tolist() for c in ("key", "a", "b")], strict=True) if (items := p.add(*x)) is not None]
            self.held.put(p.held)
            self.last.update((max([int(new["key"].iloc[-1]), *([] if last is None else [last])]),))
            if bins:
                yield self._out(key[0], bins)
        if self.idle is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        p = BufferedPacker(self.limits, self.buffer, [tuple(x) for x in self.held.get()] if self.held.exists() else [])
        bins = []
        while p.held:
            bins.append(p.take())
        self.held.clear()
        if bins:
            yield self._out(key[0], bins)

    def close(self) -> None:
        pass


def packed(rows: DataFrame, key: str, first: str, second: str, limits: tuple, buffer: int = 16, shards: int = 4, idle: int | None = None, growing: bool = False) -> DataFrame:
    """Bins of rows of a stream. The buffer of a shard is state: it survives a restart, each row is
    in at most one bin, and, if keys grow, rows that are read again are left out; rows that wait in
    a buffer come out when it is full, or after ``idle`` milliseconds. Rows without a key are left
    out. To be run inside ``keeping_lists``, as ``table_of`` and ``append_to`` do."""
    dealt = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(first).cast("long").alias("a"), F.col(second).cast("long").alias("b")).withColumn("shard", F.pmod("key", F.lit(shards)))
    schema = "shard long, bin long, place long, key long, a long, b long"
    return dealt.groupBy("shard").transformWithStateInPandas(Packer(limits, buffer, idle, growing), schema, "append", "none" if idle is None else "processingTime")


def state_of(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """One state variable of a packer's checkpoint: the shard, and ``held`` (rows that wait, in
    order), ``bins`` or ``last``."""
    with keeping_lists(spark):
        read = spark.read.format("statestore").option("stateVarName", name)
        if name == "held":
            rows = read.option("flattenCollectionTypes", "false").load(checkpoint)
            return rows.select(F.col("key.shard").alias("shard"), F.col("list_value").alias("held"))
        rows = read.load(checkpoint)
        return rows.select(F.col("key.shard").alias("shard"), F.col(f"value.{'n' if name == 'bins' else 'key'}").alias(name))


def packed_table(rows: DataFrame, key: str, first: str, second: str, limits: tuple, buffer: int = 16, shards: int = 4, checkpoint: str | None = None, growing: bool = False) -> DataFrame:
    """All bins of a stream that has ended: those that it emitted, and what waits in its state,
    packed too, so that no row is missing."""
    spark = rows.sparkSession
    place = checkpoint or new_folder(spark, "marks")
    emitted = table_of(packed(rows, key, first, second, limits, buffer, shards, growing=growing), checkpoint=place)
    return emitted.unionByName(drained(spark, place, limits, buffer)) if exists(spark, f"{place}/state") else emitted


def drained(spark: SparkSession, checkpoint: str, limits: tuple, buffer: int = 16) -> DataFrame:
    """The bins of what waits in a packer's state; the state stays as it is."""
    own = as_limits(limits)

    def drain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for shard, n, held in zip(f["shard"].tolist(), f["n"].tolist(), f["held"].tolist(), strict=True):
                p = BufferedPacker(own, buffer, [(int(x["key"]), int(x["a"]), int(x["b"])) for x in held])
                while p.held:
                    out += [(shard, n, i, *x) for i, x in enumerate(p.take())]
                    n += 1
            yield pd.DataFrame(out, columns=["shard", "bin", "place", "key", "a", "b"])

    waiting = state_of(spark, checkpoint, "held").join(state_of(spark, checkpoint, "bins"), "shard", "left")  # one row a shard
    waiting = waiting.select("shard", F.coalesce("bins", F.lit(0)).cast("long").alias("n"), "held")
    return waiting.mapInPandas(drain, "shard long, bin long, place long, key long, a long, b long")
