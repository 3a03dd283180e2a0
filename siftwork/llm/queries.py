"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm import (
    alignment, embedding_dedup, exact_dedup, hilbert_shards, html_extract, mixing, ngram_jaccard, packing, quality_classifier, quality_rules,
    suffix_dedup, url_filter, whitening,
)
from siftwork.sources.checkpoints import materialize

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER = "byte_bpe_50k.json"
OTHER_TOKENIZER = "piece_bpe_32k.model"
ACCEPT = 0.3  # the least score of an accepted document
SHARDS = 24


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_hilbert_shards(spark: SparkSession, folder: str) -> DataFrame:
    body = F.coalesce("text", F.lit("")).cast("binary")
    docs = table(spark, folder, "documents").select(
        "doc_id", (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), "lang", "source"
    )
    placed = hilbert_shards.shard_rows(docs, ["lang", "source", "size"], SHARDS, ties=["doc_id", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), tokenizer_path())


def op3_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    sized = materialize(docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size")), "sizes")
    return mixing.mix(sized).select("doc_id", "size", "source_size", "target", "taken")


def op4_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.extract(table(spark, folder, "pages"))


def op5_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_jaccard.jaccard_groups(table(spark, folder, "documents"))


def op6_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(table(spark, folder, "pages"))


def op7_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.repeat_report(table(spark, folder, "documents"))


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = quality_rules.ledger(table(spark, folder, "documents").select("doc_id", "text"))
    base, kept = ~quality_rules.passes(quality_rules.BASE), quality_rules.passes(quality_rules.POLICIES["v1"])
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), kept.alias("kept")
    )


def op9_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality_classifier.train(docs, table(spark, folder, "labels"))
    scored = quality_classifier.score(docs.select("doc_id", "text"), model, ["doc_id"])
    return scored.select(
        "doc_id", quality_classifier.is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted")
    )


def op10_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"))


def op11_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align_tokenizers(table(spark, folder, "documents"), tokenizer_path(), tokenizer_path(OTHER_TOKENIZER))


def op12_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, folder, "documents"))


def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    found = whitening.whiten(table(spark, folder, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation as long)"))  # null where no long can hold it


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_hilbert_shards, op2_best_fit_packing, op3_source_mixing, op4_html_extraction, op5_ngram_jaccard,
        op6_url_filters, op7_suffix_dedup, op8_quality_rules, op9_quality_classifier, op10_embedding_dedup,
        op11_tokenizer_alignment, op12_exact_dedup, op13_embedding_whitening,
    )
}
