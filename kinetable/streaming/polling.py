"""A folder that is polled: what lies there is taken up once it has been left alone for a while,
once each, over restarts.

A stream lists the folder (paths, change times and sizes, not the contents). The files of one unit
(by default a file, else the folder of that depth, as a checkpoint's many files) meet in a state
that keeps the newest change and a timer: when nothing has changed for the settle time the unit
comes out. What comes out is handled batch by batch and written into a log of its own for each
batch, so that a batch that runs again after a stop overwrites its entry and a unit isn't handled
twice; a unit in the log is left out even if its files are touched again."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.files import listed
from .events import keeping_lists

#: What is known of a unit when it comes out.
UNIT = "unit string, n_files long, bytes long, changed timestamp"


#: In how many tasks the facts of a batch's files are looked up: by default one for each file, up to 10,000.
LOOKUPS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def look_up_in_lots(spark: SparkSession) -> None:
    """Files are looked up many to a task. A source of files reads the setting from the session that
    defined it, while the stream runs, so it stays."""
    most = 4 * spark.sparkContext.defaultParallelism
    if int(spark.conf.get(LOOKUPS)) > most:
        spark.conf.set(LOOKUPS, str(most))


class Settled(StatefulProcessor):
    """One unit: number and bytes of its files, the newest change, and whether it has come out."""

    def __init__(self, settle_ms: int):
        self.settle = settle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "n long, bytes long, changed long, out boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, size, changed, out = self.seen.get() if self.seen.exists() else (0, 0, 0, False)
        for f in rows:
            n, size, changed = n + len(f), size + int(f["length"].sum()), max(changed, int(f["changed"].max()))
        self.seen.update((n, size, changed, out))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if not out:  # at the earliest in the next batch
            self.handle.registerTimer(max(changed + self.settle, timerValues.getCurrentProcessingTimeInMs() + 1))
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, size, changed, _ = self.seen.get()
        self.seen.update((n, size, changed, True))
        yield pd.DataFrame({"unit": [key[0]], "n_files": [n], "bytes": [size], "changed": [pd.Timestamp(changed, unit="ms")]})

    def close(self) -> None:
        pass


def units(spark: SparkSession, folder: str, settle_ms: int, pattern: str = "*", depth: int | None = None) -> DataFrame:
    """The stream of settled units below the folder. ``depth``: how many parts of a path below the
    folder name a unit (all of them: a file is one). To be run inside ``keeping_lists``."""
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    found = found.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)  # contents aren't read: the column is pruned
    root = folder.rstrip("/").removeprefix("file://").removeprefix("file:")
    below = F.expr("substring_index(path, '{}/', -1)".format(root.replace("'", "''")))
    unit = below if depth is None else F.substring_index(below, "/", depth)
    rows = found.select(unit.alias("unit"), F.unix_millis("modificationTime").alias("changed"), "length")
    return rows.groupBy("unit").transformWithStateInPandas(Settled(settle_ms), UNIT, "append", "processingTime")


def done(spark: SparkSession, log: str) -> DataFrame:
    """The log: units that were handled, with the batch that did it."""
    parts = listed(spark, f"{log}/batch=*")
    if not parts:
        return spark.createDataFrame([], f"{UNIT}, batch long")
    return spark.read.schema(UNIT).option("basePath", log).parquet(*parts).withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), "batch=([0-9]+)", 1).cast("long"))


def poll(spark: SparkSession, folder: str, log: str, checkpoint: str, settle_ms: int, handle: Callable[[DataFrame], None] | None = None, every: str = "1 second", pattern: str = "*", depth: int | None = None):
    """Start polling; ``handle`` gets the table of each batch's units before they are logged, and
    may get them again if it, or the log's writing, was stopped half-way. Returns the query; the
    folder of ``log`` is only this query's."""

    def put(batch: DataFrame, number: int) -> None:
        own = done(batch.sparkSession, log).where(F.col("batch") != number).select("unit")
        new = batch.join(own, "unit", "left_anti").select("unit", "n_files", "bytes", "changed").persist()
        try:
            if not new.isEmpty():
                if handle:
                    handle(new)
                new.write.mode("overwrite").parquet(f"{log}/batch={number}")
        finally:
            new.unpersist()

    look_up_in_lots(spark)
    with keeping_lists(spark):
        out = units(spark, folder, settle_ms, pattern, depth).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        return out.trigger(processingTime=every).foreachBatch(put).start()


def wait(query, log: str, units: int, seconds: float = 300.0) -> None:
    """Until so many units are in the log, or the query has failed or the time is over."""
    end = time.time() + seconds
    while done(SparkSession.active(), log).count() < units:
        if query.exception() is not None:
            raise query.exception()
        if time.time() > end:
            raise TimeoutError(f"fewer than {units} units came out in {seconds} s")
        time.sleep(0.5)


def stop(query, seconds: float = 5.0) -> None:
    """Stop, between two batches if one ends in time; a batch that is cut off runs again later."""
    end = time.time() + seconds
    while query.isActive and query.status["isTriggerActive"] and time.time() < end:
        time.sleep(0.02)
    query.stop()
