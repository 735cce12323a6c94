"""Importance resampling towards a target's distribution, by a table of words and their places.

Documents are dealt by row, their words exploded with places, and a window of each document gives
every word those that follow, so a row of the table has its runs of one, two and three words, each
as a bucket of its hash. Buckets are counted over all documents and over the target. A bucket's
gain is the logarithm of how much likelier the target is to hold it; gains are joined to the table
and summed up for each document. Noise that depends on the document's id alone is added, and the
highest sums of documents that are long enough are drawn: sampling without replacement, the same
each time. The order is dealt in ranges, so no task sees all documents.

Rows: null text has no words; documents without words count with no features and weight 0. A row
with a null id has no noise, so no score, and is never drawn (nor counted among those that may
be). Rows that repeat an id are documents of their own with one noise; ties go to the smaller id,
then to the row read first. An empty table, or target, gives what the formulas give: no rows, or
gains from the documents alone. Further columns, whatever their names, are not read. Rows are
numbered as they are read, so ``docs`` has to be a table, or what reads one in the same way again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, prepare

#: Words: runs of what isn't an ASCII control, mark or space; A-Z are lowered afterwards.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _lowered(word: Column) -> Column:
    """A-Z in lower case; a word of ASCII alone needs no table of letters."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, UPPER.lower()))


def position_table(docs: DataFrame, buckets: int, orders: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, b1, b2, ...): a row for each word, with the bucket of the run of k words that
    begins there (null where the document has ended); a document without words has one row of
    nulls. Texts are dealt once, and exploded, ordered and hashed where they then are."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartition("row")
    words = rows.select("row", "id", F.posexplode_outer(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("place", "word"))
    words = words.withColumn("word", _lowered(F.col("word")))
    w = Window.partitionBy("row").orderBy("place")
    run = [F.col("word"), *[F.lead("word", k).over(w) for k in range(1, orders)]]
    words = words.select("row", "id", *[c.alias(f"w{k}") for k, c in enumerate(run, 1)])
    blank, parts, hashed = F.lit(" "), [], []
    for k in range(1, orders + 1):
        parts += [blank] * (k > 1) + [F.col(f"w{k}")]
        hashed.append((F.crc32(F.concat(*parts).cast("binary")) % buckets).cast("int").alias(f"b{k}"))
    return words.select("row", "id", *hashed)


def _counts(table: DataFrame, orders: int) -> DataFrame:
    """(bucket, n) over all orders."""
    out = None
    for k in range(1, orders + 1):
        one = table.where(f"b{k} is not null").groupBy(F.col(f"b{k}").alias("bucket")).agg(F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(own: DataFrame, target: DataFrame, buckets: int, orders: int = 3) -> DataFrame:
    """(bucket, gain) from two position tables, one row a bucket."""
    s = materialize(_counts(own, orders), "counts", few=True)
    t = materialize(_counts(target, orders), "counts", few=True)
    of = lambda df: float(df.agg(F.sum("n")).first()[0] or 0)
    all_s, all_t = of(s) + buckets, of(t) + buckets
    both = own.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(s.withColumnRenamed("n", "s"), "bucket", "left").join(t.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0, ["s", "t"])
    ratio = (F.col("t") + 1).cast("double") * F.lit(all_s) / ((F.col("s") + 1).cast("double") * F.lit(all_t))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def _noise(id_: Column, seed: int) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def importance(
    docs: DataFrame, target: DataFrame, buckets: int = 10_000, orders: int = 3, percent: int = 5, least_words: int = 20, seed: int = 42, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of ``docs``: id, n_features, weight, score and rank (1, 2, ... among the drawn, else
    null). ``percent`` of those with ``least_words`` words are drawn."""
    prepare(docs.sparkSession)
    table = materialize(position_table(docs, buckets, orders, id_col, text_col), "positions")
    aim = materialize(position_table(target, buckets, orders, target.columns[0], text_col), "target_positions")
    gain = materialize(gains(table, aim, buckets, orders), "gains", few=True)
    discard(aim)

    known, names = table, [f"b{k}" for k in range(1, orders + 1)]
    for b in names:  # one row a bucket
        known = known.join(F.broadcast(gain.select(F.col("bucket").alias(b), F.col("gain").alias(f"gain_{b}"))), b, "left")
    total = sum((F.coalesce(F.col(f"gain_{b}"), F.lit(0)) for b in names), F.lit(0))
    n = sum((F.col(b).isNotNull().cast("int") for b in names), F.lit(0))
    scored = known.groupBy("row", "id").agg(F.sum(n).alias("n_features"), F.sum(total).alias("weight"), F.count("b1").alias("n_words"))
    scored = materialize(scored.withColumn("score", F.col("weight") + _noise(F.col("id"), seed)), "scored")
    discard(table, gain)

    may = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    drawn = scored.where(may).count() * percent // 100
    order = [F.desc("score"), F.col("id"), F.col("row")]
    ranged = scored.where(may).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialize(ranged.withColumn("at", F.monotonically_increasing_id()), "order")  # its upper bits are the range
    ranged = ranged.withColumn("range", F.shiftright("at", 33))
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("range", before.alias("before")))  # one row a range
    place = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = ranged.join(starts, "range").withColumn("rank", F.when(place <= drawn, place))
    out = ranked.select("id", "n_features", "weight", "score", "rank").unionByName(scored.where(~may).select("id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))
    return out.withColumnRenamed("id", id_col)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """The drawn rows of ``docs``, all their columns, in no order."""
    ranks = importance(docs, target, id_col=id_col, **settings).where("rank is not null").select(id_col).distinct()
    return docs.join(ranks, id_col, "left_semi")
