"""From raw documents to packed training sequences: five stages, each the next one's input.

1. quality classifier: documents that it rejects go.
2. n-gram Jaccard join: of each group of near-duplicates the row with the smallest doc_id stays, and
   no second row of the same document.
3. suffix-array dedup: strings of 200 bytes that start more than once are cut from the texts.
4. mixing sources to target weights: rows repeat or go as their source's target asks.
5. best-fit packing: the documents' tokens take places in sequences of 2048.

A stage takes (spark, docs, sf_dir) and reads `docs` only, and `labels` of sf_dir for training. All
but the last return the columns of their input. `run` writes each result as Parquet in the shared
folder and reads it again, so a lost executor costs a stage's own work at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm import mixing, ngram_jaccard, packing, quality_classifier, suffix_dedup
from siftwork.llm.queries import ACCEPT, table, tokenizer_path
from siftwork.sources.checkpoints import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches ACCEPT. Rows without doc_id and empty texts are scored like others."""
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.accepted(docs, model, ACCEPT)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group, the one with the smallest doc_id, null ids last. Rows without words stay."""
    return ngram_jaccard.first_of_groups(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without its repeated strings; n_chars follows the text."""
    cut = suffix_dedup.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mixture takes it (0, 1 or 2); rows without words go.

    Rows without doc_id and rows that repeat one are judged each by its own source and text.
    """
    size = mixing.n_words(F.col("text")).alias("size")
    limits = mixing.source_limits(materialize(docs.select("doc_id", "source", size), "sizes"))
    # The whole row in one column, so that no column of `docs` meets one of the mixture.
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", "source", size).filter("size > 0")
    taken = mixing.take(rows, limits).filter("taken > 0")
    return taken.select("_row", F.explode(F.expr("sequence(1, int(taken div size))"))).select("_row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_strings),
    ("source_mixing", mixture),
    ("best_fit_packing", packed),
]

#: SQL expresses neither the trained classifier nor the tokenizer; tests/llm/test_pipeline.py compares every stage with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
