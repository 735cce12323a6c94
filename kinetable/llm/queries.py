"""The queries that apply the operators of this subpackage to whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, bytebpe, exact, graph, icws, langid, lbl, oracles, packing, passages, resample, suffix, trie, warc
from .common import table

TOKENIZER, RANKS = "word_bpe_49k.json", "byte_bpe_50k.tiktoken"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_passages(table(spark, sf_dir, "documents"), words=50, threshold=0.8)


def op2_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.near_vectors(table(spark, sf_dir, "embeddings"), least=0.95)


def op3_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2, tokens=4096, segments=64)
    return out.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op4_warc_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.capture_history(table(spark, sf_dir, "pages"), min_bytes=0)


def op5_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return icws.near_duplicates(table(spark, sf_dir, "documents"), threshold=0.8)


def op6_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.tokenize(table(spark, sf_dir, "documents"), tokenizer_path())
    return out.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_exact_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.col("norm").cast("binary"), 256)
    return exact.exact_groups(table(spark, sf_dir, "documents"), carry={"text_sha256": digest})


def op8_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbl.score(table(spark, sf_dir, "documents"))


def op9_ecoc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs, ["doc_id"], langid.train(docs))
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op10_suffix_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.remove_repeats(table(spark, sf_dir, "documents"), length=50)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op11_position_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return resample.importance(docs, target, buckets=10_000, orders=3, percent=5, least_words=20, seed=42)


def op12_byte_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bytebpe.tokenize(table(spark, sf_dir, "documents"), tokenizer_path(RANKS), offsets=False)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_heavy_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_compact_windows, op2_pruned_graph, op3_vector_packing, op4_warc_merge, op5_weighted_sampling, op6_bpe_tree, op7_exact_refine, op8_log_bilinear, op9_ecoc_language, op10_suffix_refine, op11_position_ngrams, op12_byte_slices, op13_heavy_paths)
}

ORACLES: dict[str, str] = {
    "op7_exact_refine": """
        with d as (select doc_id, coalesce(text, '') as t,
                regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') as norm from documents),
            h as (select doc_id, length(t) as points, sha256(norm) as text_sha256 from d),
            g as (select *, count(*) over (partition by text_sha256) as group_size,
                first_value(doc_id) over (partition by text_sha256 order by points desc, doc_id) as keep_id from h)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from g
    """,
    "op11_position_ngrams": oracles.POSITION_NGRAMS,
    "op13_heavy_paths": oracles.HEAVY_PATHS,
}
