"""Exact deduplication by progressive refinement, with built-in functions only.

Rows are grouped by the length of the normalised text, those of shared lengths by a hash of
its first characters as well, and only what still has company is hashed in full. The first
scan writes narrow rows (length and prefix hash), from which both groupings are made; the
second scan hashes the texts whose length and prefix are shared. It knows them by a bitmap of
fixed size (SLOTS bits, 16 MB at most, whatever the data): a text whose slot is set only
because another key falls into it is hashed in full too and then is alone in its group. So the
steps are the same at every size, and no text is moved.

Rows: null text counts as empty, and empty texts are equal to each other; rows that
repeat a document get the same answer; a row with a null id is compared like any other
and is preferred last. Further columns, whatever their names, are not read. A text of any
length is read once in each scan, in place.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, small, with_groups

#: Characters of the normalised text in the prefix hash; bits of the bitmap, and of one row of it.
PREFIX, SLOTS, CHUNK = 128, 1 << 27, 1 << 15


def normalised(text: Column) -> Column:
    """The text without space, tab, line feed, vertical tab, form feed, carriage return."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def _slot(n: Column, prefix: Column) -> Column:
    return F.pmod(F.xxhash64(n, prefix), F.lit(SLOTS))


def _bitmap(keys: DataFrame) -> DataFrame:
    """(chunk, bits): the slots of the keys (n, prefix); at most SLOTS / CHUNK rows of 4 kB."""
    slot = _slot(F.col("n"), F.col("prefix"))
    return keys.groupBy(F.floor(slot / CHUNK).cast("int").alias("chunk")).agg(F.bitmap_construct_agg((slot % CHUNK).cast("int")).alias("bits"))


def _is_set(bits: Column, slot: Column) -> Column:
    at = (slot % CHUNK).cast("int")
    byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return F.coalesce(F.getbit(byte, at % 8) == 1, F.lit(False))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, and the ``carry``
    columns, expressions over ``norm`` (normalised text) made in the last scan."""
    base = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"), F.coalesce(F.char_length(text_col), F.lit(0)).alias("points"))
    base = base.withColumns({"n": F.octet_length("norm"), "prefix": F.xxhash64(F.substring("norm", 1, PREFIX))})

    narrow = materialize(base.select("n", "prefix"), "narrow")
    # lengths are few (no more than the longest text has bytes), so their table is too
    lengths = materialize(narrow.groupBy("n").count().where("count > 1").select("n"), "lengths", few=True)
    keys = narrow.join(small(lengths), "n", "left_semi").groupBy("n", "prefix").count().where("count > 1").select("n", "prefix")
    bitmap = materialize(_bitmap(keys), "bitmap", few=True)
    discard(narrow, lengths)

    carry = dict(carry or {})
    slot = _slot(F.col("n"), F.col("prefix"))
    marked = base.withColumn("_s", slot).join(F.broadcast(bitmap), F.floor(F.col("_s") / CHUNK).cast("int") == F.col("chunk"), "left")
    full = F.when(_is_set(F.col("bits"), F.col("_s")), F.sha2(F.col("norm").cast("binary"), 256))
    rows = materialize(marked.select("id", "points", "n", full.alias("full"), *[c.alias(f"c_{k}") for k, c in carry.items()]), "hashed")
    discard(bitmap)

    best = F.min(F.struct(-F.col("points"), F.col("id").isNull(), F.col("id")))
    groups = rows.where("full is not null").groupBy("full", "n").agg(F.count("*").alias("group_size"), best.getField("id").alias("keep_id"))
    groups = materialize(groups.where("group_size > 1"), "groups", few=True)
    known = with_groups(rows.where("full is not null"), groups.withColumn("found", F.lit(True)), ["full", "n"], "group_size", rows.count(), "left")
    known = known.withColumns({"group_size": F.coalesce("group_size", F.lit(1)), "keep_id": F.when(F.col("found"), F.col("keep_id")).otherwise(F.col("id"))}).drop("found")
    alone = rows.where("full is null").withColumns({"group_size": F.lit(1).cast("long"), "keep_id": F.col("id")})
    out = known.select(*alone.columns).unionByName(alone)
    return out.select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), *[F.col(f"c_{k}").alias(k) for k in carry]
    )
