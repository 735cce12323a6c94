"""Going on after a stop: states of workers, checkpoints, settled inputs, stages that are done."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def newest_states(states: DataFrame, worker: str, version: str, payload: str) -> DataFrame:
    """Of each worker the state with the highest version: a partial aggregation, so it may be
    applied again to merged states of several nodes."""
    best = F.max(F.struct(F.col(version).alias("v"), F.col(payload).alias("p")))
    return states.groupBy(worker).agg(best.alias("_b")).select(worker, F.col("_b.v").alias(version), F.col("_b.p").alias(payload))


def after_checkpoint(rows: DataFrame, seen: DataFrame, worker: str, position: str, last: str) -> DataFrame:
    """Rows behind what their worker has seen; all rows of a worker without a checkpoint."""
    return rows.join(seen, worker, "left").where(F.col(last).isNull() | (F.col(position) > F.col(last))).drop(last)


def settled(files: DataFrame, changed: str, now: Column, idle: str, done: DataFrame, on: list[str]) -> DataFrame:
    """Files that haven't changed for a while and aren't in the log of done ones."""
    return files.where(F.col(changed) <= now - F.expr(f"interval {idle}")).join(done.select(*on).distinct(), on, "left_anti")


def run_stages(spark: SparkSession, stages: dict[str, Callable[[], DataFrame]], folder: str) -> Iterator[tuple[str, str]]:
    """Write each stage's table into the folder, unless its mark of success is there."""
    jvm, conf = spark.sparkContext._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for name, stage in stages.items():
        mark = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/_SUCCESS")
        if mark.getFileSystem(conf).exists(mark):
            yield name, "skipped"
        else:
            stage().write.mode("overwrite").parquet(f"{folder}/{name}")
            yield name, "ran"


class BoundedCache:
    """The last ``size`` items by key; the oldest one goes first, and ``close`` is called on it."""

    def __init__(self, size: int, close: Callable | None = None):
        self.size, self.close, self.items = size, close, OrderedDict()

    def get(self, key, make: Callable):
        if key not in self.items:
            self.items[key] = make()
            while len(self.items) > self.size:
                _, old = self.items.popitem(last=False)
                if self.close:
                    self.close(old)
        return self.items[key]
