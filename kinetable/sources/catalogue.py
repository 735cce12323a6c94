"""Sources by name: where they lie, how they are laid out, and one scan for all of them."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tracks


@dataclass(frozen=True)
class Source:
    """A source of track archives; its root is an environment variable's or a default place."""

    name: str
    env: str
    default: str
    split_file: str = "splits.json"
    options: dict = field(default_factory=dict)

    @property
    def root(self) -> str:
        return os.environ.get(self.env) or self.default


class Catalogue:
    def __init__(self, *sources: Source):
        self.sources: dict[str, Source] = {}
        for s in sources:
            self.add(s)

    def add(self, source: Source) -> None:
        if source.name in self.sources:
            raise ValueError(f"source {source.name} exists")
        self.sources[source.name] = source

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(s.name, s.env, s.root, s.split_file) for s in self.sources.values()]
        return spark.createDataFrame(rows, "name string, env string, root string, split_file string")

    def scan(self, spark: SparkSession, names: list[str] | None = None) -> DataFrame:
        """Rows of the named sources (all by default) with ``dataset``; only their files are read."""
        unknown = set(names or ()) - set(self.sources)
        if unknown:
            raise KeyError(f"no source {', '.join(sorted(unknown))}")
        out = None
        for n in names or sorted(self.sources):
            s = self.sources[n]
            rows = tracks.read_tracks(spark, s.root, **s.options).withColumn("dataset", F.lit(n))
            out = rows if out is None else out.unionByName(rows)
        return out
