"""Exact dedup: runs of sorted digests, merged in rounds until every text has met its copies.

Each partition sorts the digests of its texts and folds equal ones into one entry, the smallest row
and a count. Then runs are exchanged in binomial rounds: partitions whose numbers differ only in the
round's bits form a group, each sends every member the part of its run that has the member's bits in the
digest, and merges the runs that it receives. After the last round a partition holds one slice of all
digests. A text that fills a third of the table is one entry of a run from the first level on, so a
task meets as many of them as runs in a group, never as many as rows.

Entries fold only if they are verified: beside SHA-256 also MD5 and the length must agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.llm.hot_groups import join_classes
from siftwork.sources.checkpoints import materialize, materialize_counting

_BLANKS = r"[\x20\x09-\x0D]+"
_ENTRY = ("place", "digest", "witness", "no_id", "doc_id", "row")


def normalised(text: Column) -> Column:
    """The text (null: empty) with one space for each run of blanks."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), _BLANKS, " ")


def _digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, witness, row): one row per document, with the row's number."""
    body = normalised(F.col("text")).cast("binary").alias("body")
    return docs.select("doc_id", body).select(
        "doc_id",
        F.unhex(F.sha2("body", 256)).alias("digest"),
        F.concat(F.unhex(F.md5("body")), F.unhex(F.lpad(F.hex(F.octet_length("body").cast("long")), 16, "0"))).alias("witness"),
        F.monotonically_increasing_id().alias("row"),
    )


def _fold(runs: DataFrame) -> DataFrame:
    """One entry per class and place, the first in order, with the sum of n. Streams over merged runs."""

    def bounds(rows: pa.Table) -> np.ndarray:
        fresh = np.ones(len(rows), bool)
        place = rows.column("place").to_numpy()
        fresh[1:] = place[1:] != place[:-1]
        for name, width in (("digest", 32), ("witness", 24)):
            fixed = rows.column(name).combine_chunks().cast(pa.binary(width))
            raw = np.frombuffer(fixed.buffers()[1], np.uint8)[fixed.offset * width :][: len(rows) * width].reshape(-1, width)
            fresh[1:] |= (raw[1:] != raw[:-1]).any(1)
        return np.flatnonzero(fresh)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for rows in batches:
            if not len(rows):
                continue
            rows = pa.RecordBatch.from_arrays(rows.columns, rows.schema.names)  # the same schema, nullable or not
            table = pa.Table.from_batches([*held, rows])
            first = bounds(table)
            n = np.add.reduceat(table.column("n").to_numpy(), first)
            entries = table.take(pa.array(first)).set_column(table.schema.get_field_index("n"), "n", pa.array(n)).combine_chunks()
            yield from entries.slice(0, len(first) - 1).to_batches()
            held = entries.slice(len(first) - 1).to_batches()  # the next batch may go on with its class
        yield from held

    return runs.sortWithinPartitions(*_ENTRY).mapInArrow(run, runs.schema)


def merge_runs(runs: DataFrame, partitions: int, bits: int = 3) -> DataFrame:
    """The classes of all runs, one entry each, over at least `partitions` slices of the digests.

    `runs` are folded entries (place, digest, witness, no_id, doc_id, row, n), place being the run.
    A round merges 2^bits runs.
    """
    levels = max(1, math.ceil(math.log2(max(2, partitions))))
    lead = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    owner = F.shiftright(lead, 32 - levels)
    runs = runs.withColumn("place", F.col("place").bitwiseAND((1 << levels) - 1))
    for low in range(0, levels, bits):
        mask = (1 << min(low + bits, levels)) - (1 << low)
        target = F.col("place").bitwiseAND(~mask).bitwiseOR(owner.bitwiseAND(mask))
        sent = runs.withColumn("place", target)
        runs = _fold(sent.repartitionById(1 << levels, F.col("place").cast("int")))
    return runs


def _classes(rows: DataFrame, bits: int) -> DataFrame:
    """(digest, witness, keep_id, keep_row, group_size) of every text that more than one row of `rows` holds."""
    entries = rows.select(
        F.spark_partition_id().cast("long").alias("place"), "digest", "witness", F.isnull("doc_id").alias("no_id"), "doc_id", "row", F.lit(1).cast("long").alias("n")
    )
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    merged = merge_runs(_fold(entries), partitions, bits).filter("n > 1")
    return merged.select("digest", "witness", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("n").alias("group_size"))


def _judged(docs: DataFrame, bits: int) -> DataFrame:
    rows, total = materialize_counting(_digests(docs), "digests")
    classes = materialize(_classes(rows, bits), "copies")
    joined = join_classes(rows, classes, ["digest", "witness"], "group_size", total, "left")
    alone = F.isnull("group_size")
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "row",
    )


def exact_groups(docs: DataFrame, bits: int = 3) -> DataFrame:
    """One row per row of `docs(doc_id, text)`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they agree after every run of blanks became one space; null counts as empty,
    and empty texts are equal to each other. Of equal texts the row with the smallest doc_id stays, null ids
    last; of rows that also share the id exactly one stays. keep_id is the id of that row, null if all
    ids of the group are. Other columns are not read; an empty table gives none.
    """
    return _judged(docs, bits).drop("row")


def first_copies(docs: DataFrame, bits: int = 3) -> DataFrame:
    """Whole rows of `docs`, whatever their other columns: the one that stays of each group of equal texts."""
    numbered = materialize(docs.select(F.struct("*").alias("_row"), "doc_id", "text"), "rows")
    own = numbered.select("_row", F.monotonically_increasing_id().alias("row"))
    gone = _judged(numbered, bits).filter("not kept").select("row")
    return own.join(gone, "row", "left_anti").select("_row.*")
