"""Connected components of a link table by alternating large-star and small-star steps.

Each step is one aggregation and one join over the links, whose keys are pre-aggregated,
and its result is written to the shared folder. Nothing goes to the driver but a count.

Rows: links may repeat and come in either order; a link of a node with itself or with a null
end is left out (a node that has no other link isn't returned); no links give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each node of a link the smallest node it reaches."""
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()  # greatest and least skip nulls: then u = v
    e = materialize(e, "links", few=True)
    while True:
        # large star: neighbours above a node go to the smallest of its neighbourhood
        both = e.union(e.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # small star: a node and its neighbours below go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.toDF("u", "v")).where("u > v").distinct()
        new = materialize(small, "links", few=True)
        if _mark(new) == _mark(e):
            discard(new)
            break
        discard(e)
        e = new
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.union(roots)


def _mark(e: DataFrame) -> tuple:
    """Equal for equal sets of links."""
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first())
