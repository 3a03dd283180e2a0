"""Ranks within keys that may hold any share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.sources.checkpoints import materialize, materialize_counting

TASK_ROWS = 1 << 20


def ranked_within(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], name: str = "rank", task_rows: int = TASK_ROWS) -> DataFrame:
    """`df` with the place (from 1) of each row among the rows of its key, in the order given.

    No key passes through one task: keys of at most `task_rows` rows are ranked whole, the others
    in ranges. The ranks are the same either way. Rows are written and counted by key first. Null is a key like
    any other; rows that tie follow each other in any order.
    """
    table = materialize(df, "unranked").withColumn("_key", F.struct(*by))
    sizes = table.groupBy("_key").agg(F.count("*").alias("_n"))
    # No more of these keys than rows / task_rows; a written table has a size that Spark can plan by.
    hot, found = materialize_counting(sizes.filter(F.col("_n") > task_rows).select("_key"), "hot-keys")
    place = F.row_number().over(Window.partitionBy("_key").orderBy(*order)).cast("bigint").alias(name)
    if not found:
        return table.select(*df.columns, place)
    plain = table.join(hot, "_key", "left_anti").select(*df.columns, place)
    return plain.union(_ranked_in_ranges(table.join(hot, "_key", "left_semi"), order, name).select(*df.columns, name))


def _ranked_in_ranges(table: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """The ranks by `_key` from ranges of about equal counts: the place in the range, and the rows of the key in the ranges before.

    The ranges are written once, as cutting anew could move their borders; rows that tie share one.
    """
    ranged = materialize(table.repartitionByRange("_key", *order).withColumn("_range", F.spark_partition_id()), "ranges")
    inner = Window.partitionBy("_key", "_range").orderBy(*order)
    ranked = ranged.withColumn("_inner", F.row_number().over(inner).cast("bigint"))
    before = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_key", "_range").agg(F.count("*").alias("_n"))
    # A range goes on with one key at most, so no more rows stay than there are ranges.
    starts = counts.withColumn("_before", F.sum("_n").over(before)).filter("_before > 0").drop("_n")
    placed = ranked.join(starts, ["_key", "_range"], "left")
    return placed.withColumn(name, F.col("_inner") + F.coalesce("_before", F.lit(0)))
