"""From raw documents to packed training sequences.

Each stage takes the documents that its predecessor kept and returns those it keeps (the last
one returns packed pieces). Further columns, whatever their names, go through unchanged, and
so does ``n_chars`` but where a text is cut; it may be missing.

Rows: a null or empty text has no language and goes in the first stage. Rows of one id are
judged each by its text; of repeated rows one stays. A row with a null id is compared by the
exact stage as any other, and isn't judged by the stages on near copies and on repeats, which
name documents by id. Empty tables give empty results; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetable.llm import exact, icws, langid, packing, suffix
from kinetable.llm.common import discard, materialize, prepare, scratch, small
from kinetable.llm.queries import tokenizer_path


#: A text is in no language if the best of the learnt languages leads the next by less.
LEAD = 0.05


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which no language is found: those without text or a letter, and those
    whose two best languages share the score within LEAD. With nothing to learn from, all with
    a letter stay."""
    prepare(spark)
    model = langid.train(docs)
    if model is None:
        return docs.where(F.col("text").rlike("\\p{L}"))
    names = {c: f"_{i}" for i, c in enumerate(docs.columns)}  # no clash with what is added
    own = docs.select("text", *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    known = langid.identify(own, list(names.values()), model, LEAD)
    return known.where((F.col("lang_pred") != "und") & ~F.col("ambiguous")).select(*[F.col(n).alias(c) for c, n in names.items()])


def _inside(docs: DataFrame) -> DataFrame:
    """The id, the text, and the whole row as one column, so that no other name can clash."""
    return docs.select(F.col("doc_id").alias("own"), F.col("text").alias("own_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def _digest(text: str) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space, keep the one with the longest text, and one row
    of it. Rows of one id with different texts are judged each by its text."""
    prepare(spark)
    groups = exact.exact_groups(docs, carry={"norm_hash": F.sha2(F.col("norm").cast("binary"), 256)}).where("group_size > 1")
    marks = groups.groupBy(F.col("doc_id").alias("of"), "norm_hash").agg(F.max("kept").alias("stays"), F.count("*").alias("rows"))
    marks = materialize(marks.where("not stays or rows > 1"), "marks", few=True)
    rows = _inside(docs).withColumn("hash", F.sha2(exact.normalised(F.col("own_text")).cast("binary"), 256))
    marked = rows.join(small(marks), F.col("own").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("norm_hash")), "left")
    # of repeated rows the longest text, by a partial aggregation
    order = F.struct(F.char_length("own_text"), F.xxhash64("own_text"))
    one = marked.where("stays").groupBy("own", "hash").agg(F.max_by("row", order).alias("row"))
    return marked.where("stays is null").select("row.*").unionByName(one.select("row.*"))


def _named(docs: DataFrame) -> DataFrame:
    """The documents with ``name``: their id, but where rows of one id differ in text, all texts
    of it but one get a name of their own from a hash, above the ids of real documents."""
    rows = _inside(docs).withColumn("hash", _digest("own_text"))
    ids = rows.where("own is not null").groupBy("own").agg(F.min("hash").alias("least"), F.max("hash").alias("most"))
    several = materialize(ids.where("least < most").select(F.col("own").alias("of"), "least"), "several", few=True)
    other = F.xxhash64("own", "hash").bitwiseAND(F.lit((1 << 61) - 1)) + F.lit(1 << 62)
    rows = rows.join(small(several), F.col("own") == F.col("of"), "left")
    return rows.withColumn("name", F.when(F.col("hash") != F.col("least"), other).otherwise(F.col("own").cast("long")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates keep the document with the smallest id."""
    prepare(spark)
    named = _named(docs)
    groups = icws.near_duplicates(named.select(F.col("name").alias("doc_id"), F.col("own_text").alias("text")), threshold=0.8)
    gone = materialize(groups.where("not kept").select(F.col("doc_id").alias("name")).distinct(), "gone", few=True)
    return named.join(small(gone), "name", "left_anti").select("row.*")


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out strings of 50 bytes that a document with a smaller id has, as far as whole
    characters go; a document of which nothing stays goes. ``n_chars`` follows the text."""
    prepare(spark)
    cut = suffix.remove_repeats(docs.select("doc_id", "text"), length=50, whole_characters=True).where("n_removed > 0")
    cut = materialize(cut.select(F.col("doc_id").alias("of"), F.col("text_hash").alias("hash"), F.col("kept_bytes").cast("string").alias("kept")).distinct(), "cut")
    rows, keys = _inside(docs).withColumn("own_hash", _digest("own_text")), small(cut.select("of", "hash"))
    same = (F.col("own").cast("long") == F.col("of")) & (F.col("own_hash") == F.col("hash"))
    rest = rows.join(keys, same, "left_anti").select("row.*")
    facts = rows.join(keys, same, "left_semi").select("own", "own_hash", F.col("row").dropFields("text").alias("row"))
    facts = materialize(facts, "cut_facts")
    new = cut.where(F.length("kept") > 0).join(small(facts), same)
    parts = {c: F.col("row").getField(c) for c in docs.columns if c != "text"} | {"text": F.col("kept")}
    if "n_chars" in parts:
        parts["n_chars"] = F.char_length("kept").cast(docs.schema["n_chars"].dataType)
    return rest.unionByName(new.select(*[parts[c].alias(c) for c in docs.columns]))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens and 64 segments."""
    prepare(spark)
    return packing.pack(docs, tokenizer_path(), end_id=2, tokens=4096, segments=64)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("packing", pack),
]

#: Language identification and packing can't be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table ``documents``. What a stage wrote on its way is deleted once its
    result is written; what the last one wrote stays, since its result is read later."""
    docs, before = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch() as made:
            docs = materialize(stage(spark, docs, sf_dir), name)
        discard(*[d for d in made if d is not docs], *([before] if before else []))
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
