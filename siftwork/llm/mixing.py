"""Mixing sources to target weights by hash thresholds, in Spark SQL expressions alone.

Every source gets a target. It takes each of its documents as often as the target allows for all
of them, and once more those whose hash lies under a threshold. The threshold comes from sums of
words by hash bucket: the first bucket that would exceed the budget is split by the next bits of the
hash, until it holds one hash. No rows are sorted, and a larger target only adds documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwork.llm.order import with_place
from siftwork.sources.checkpoints import discard, materialize

BITS = 48  # of the hash; four splits of 12 bits
_SPLIT = 12
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str = "mix") -> Column:
    """A fixed number below 2^BITS for every document."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """(source, source_size, target) for `sizes(source, size)`.

    Sources by code point, null last, weigh `weights` in turn. They share share[0]/share[1] of all
    sizes; a target stops at `most` times its source's size and the rest is shared again by
    weight. The table has a row per source and rounds add one row of sums each, so nothing
    larger than a few numbers reaches the driver. Without words every target is 0.
    """
    totals = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    ranked = with_place(totals, F.col("source").isNull(), F.col("source"), name="place")
    weight = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int")).cast("decimal(38,0)")
    full = materialize(ranked.select("source", "source_size", weight.alias("weight"), F.lit(False).alias("full")), "weights")
    discard(totals)
    size = F.col("source_size").cast("decimal(38,0)")
    while True:
        # target = weight * top / low, in whole numbers
        sums = full.agg(
            F.sum(size).alias("all"), F.sum(F.when(F.col("full"), size)).alias("capped"), F.sum(F.when(~F.col("full"), F.col("weight"))).alias("free"), F.count_if("full").alias("n")
        ).first()
        total = int(sums["all"] or 0)
        top = share[0] * total - share[1] * most * int(sums["capped"] or 0)
        low = share[1] * int(sums["free"] or 0)
        if not low:
            break
        over = F.col("full") | (F.col("weight") * F.lit(top).cast("decimal(25,0)") > F.lit(most * low).cast("decimal(18,0)") * size)
        new = materialize(full.withColumn("full", over), "weights")
        more = new.agg(F.count_if("full")).first()[0]
        discard(full)
        full = new
        if more == sums["n"]:
            break
    share_of = (F.col("weight") * F.lit(top).cast("decimal(25,0)")).cast("double") / F.lit(float(low or 1))
    return full.select("source", "source_size", F.when(F.col("full"), most * F.col("source_size").cast("double")).otherwise(share_of).alias("target"))


def _thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, threshold): documents with a hash below it make up the budget as nearly as whole hashes can.

    `rows(source, size, draw)`, `budgets(source, budget)`. Each split sums words by source and bucket,
    at most 2^12 rows per source, and goes on inside the one bucket that the budget ends in.
    """
    at = budgets.select("source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0.0).alias("before"), F.lit(0.0).alias("inside"))
    for shift in range(BITS - _SPLIT, -1, -_SPLIT):
        marks = materialize(at, "marks")
        inside = rows.join(marks.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("draw", shift + _SPLIT) == F.col("prefix")))
        sums = inside.groupBy("source", F.shiftright("draw", shift).alias("bucket")).agg(F.sum("size").cast("double").alias("words"), F.first("budget").alias("budget"), F.first("before").alias("start"))
        by_bucket = Window.partitionBy("source").orderBy("bucket")  # 2^12 rows at most
        running = sums.withColumn("through", F.col("start") + F.sum("words").over(by_bucket))
        # the last bucket that begins within the budget; its words may end beyond it
        begins = (F.col("through") - F.col("words") <= F.col("budget"))
        last = running.filter(begins).groupBy("source").agg(F.max("bucket").alias("prefix"), F.max("budget").alias("budget"))
        edge = running.join(last.select(F.col("source").alias("_s"), "prefix"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("prefix")))
        at = edge.select("source", "budget", "prefix", (F.col("through") - F.col("words")).alias("before"), F.col("words").alias("inside"))
    # one hash is left: it counts if that brings the sum nearer to the budget
    nearer = 2 * (F.col("budget") - F.col("before")) >= F.col("inside")
    return at.select("source", (F.col("prefix") + F.when(nearer, 1).otherwise(0)).alias("threshold"))


def source_limits(rows: DataFrame, weights: Sequence[int] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """(source, source_size, target, repeats, threshold) for `rows(doc_id, source, size)`, a row per source.

    A source takes each document `repeats` times, and once more if its hash lies under `threshold`.
    `rows` is read several times: pass a written table.
    """
    targets = materialize(source_targets(rows, weights, share, most), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    repeats = F.least(F.floor(ratio), F.lit(most)).cast("long")
    budgets = targets.select("source", (F.col("target") - repeats * F.col("source_size")).alias("budget")).filter("budget > 0")
    hashed = rows.select("source", "size", draw(F.col("doc_id")).alias("draw")).filter("size > 0")
    limits = materialize(_thresholds(hashed, budgets), "thresholds").select(F.col("source").alias("_t"), "threshold")
    known = targets.join(limits, F.col("source").eqNullSafe(F.col("_t")), "left")
    return known.select("source", "source_size", "target", repeats.alias("repeats"), F.coalesce("threshold", F.lit(0)).alias("threshold"))


def take(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """The rows of `rows(doc_id, source, size)` with source_size, target and `taken`, by `source_limits`."""
    known = limits.select(
        F.col("source").alias("_source"), "source_size", "target", F.col("repeats").alias("_repeats"), F.col("threshold").alias("_threshold")
    )
    joined = rows.join(known, F.col("source").eqNullSafe(F.col("_source")))
    times = F.col("_repeats") + F.when(draw(F.col("doc_id")) < F.col("_threshold"), 1).otherwise(0)
    return joined.select(*rows.columns, "source_size", "target", (F.col("size") * times).alias("taken"))


def mix(rows: DataFrame, weights: Sequence[int] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """The rows of `rows(doc_id, source, size)` with source_size, target and `taken`.

    `taken` is a multiple (0 to `most`) of the document's size. Null sources are one source, after
    all others. Rows that share a doc_id share their hash and are taken together, so a source's
    words miss its target by at most half the words of one hash; rows without doc_id share one hash.
    Extra columns are kept; an empty table gives none. `rows` is read several times: pass a written
    table.
    """
    return take(rows, source_limits(rows, weights, share, most))
