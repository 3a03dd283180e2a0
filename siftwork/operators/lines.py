"""Lines and their patterns: numbering, masking, counting, top lists, log summaries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.functions import text as tx
from siftwork.operators.ranks import ranked_within
from siftwork.sources.checkpoints import materialize


def to_lines(df: DataFrame, keep: Sequence[str], text: str, mode: str = "universal") -> DataFrame:
    """One row per line of `text`: the `keep` columns, `line_no` from 1, `line`."""
    pieces = df.select(*keep, F.posexplode(tx.text_lines(F.col(text), mode)).alias("_pos", "line"))
    return pieces.select(*keep, (F.col("_pos") + 1).cast("bigint").alias("line_no"), "line")


def dedupe_lines(
    lines: DataFrame, by: Sequence[str], mask: Callable[[Column], Column] | None = tx.mask_numbers
) -> DataFrame:
    """Equal lines (after masking) counted: (by..., pattern, n, first_no, line).

    `line` is the first original line of the pattern. Rows combine before the shuffle, so a
    source or pattern holding most of the lines sends one row per input partition.
    """
    pattern = mask(F.col("line")) if mask else F.col("line")
    return lines.groupBy(*by, pattern.alias("pattern")).agg(
        F.count("*").alias("n"),
        F.min("line_no").alias("first_no"),
        F.min_by("line", "line_no").alias("line"),
    )


def top_patterns(patterns: DataFrame, by: Sequence[str], n: int | None = None) -> DataFrame:
    """The patterns per key by frequency (the top `n` if given), ties in order of first appearance, with `rank`.

    A rank filter lets Spark cut every partition to `n` rows per key before the shuffle; without one, keys
    are ranked in ranges, so that no key passes through one task.
    """
    if n is None:
        return ranked_within(patterns, by, [F.desc("n"), F.asc("first_no")])
    order = Window.partitionBy(*by).orderBy(F.desc("n"), "first_no")
    ranked = patterns.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return ranked.withColumn("rank", F.col("rank").cast("bigint"))


def _log_patterns(lines: DataFrame) -> DataFrame:
    return lines.filter(~tx.is_blank(F.col("line")))


def log_top_patterns(lines: DataFrame, top_n: int = 25) -> DataFrame:
    """Per source the most frequent line patterns: (source, rank, n, line, pattern, first_no)."""
    # Counts and places alone stay in the hash aggregate; the lines of the few kept patterns are fetched by place.
    counted = _log_patterns(lines).groupBy("source", tx.mask_line(F.col("line")).alias("pattern")).agg(
        F.count("*").alias("n"), F.min("line_no").alias("first_no")
    )
    return _with_first_lines(lines, top_patterns(counted, ["source"], top_n))


def _with_first_lines(lines: DataFrame, top: DataFrame) -> DataFrame:
    first = lines.select("source", F.col("line_no").alias("first_no"), "line")
    return first.join(top, ["source", "first_no"]).select("source", "rank", "n", "line", "pattern", "first_no")


def log_top_patterns_by_buckets(lines: DataFrame, top_n: int = 25, buckets: int = 1 << 16) -> DataFrame:
    """The rows of `log_top_patterns`, for logs whose lines are mostly distinct patterns.

    Patterns fall into hash buckets, and a bucket's line count is a bound on the count of each of its
    patterns. The `top_n` largest buckets of a source are counted by pattern; the `top_n`-th largest count
    found there is a floor that the answer reaches. Only buckets that reach it too can hold patterns of the
    answer, and those are counted exactly, so the result does not depend on `buckets`. What is shuffled is
    bounded by `buckets` rows per source and partition, and the patterns of the buckets that stay; if all
    stay, that is every pattern, as in `log_top_patterns`. The lines are masked three times. Rows without
    source are left out; a source with fewer than `top_n` patterns returns all.
    """
    masked = _log_patterns(lines).select("source", "line_no", tx.mask_line(F.col("line")).alias("pattern"))
    placed = masked.withColumn("bucket", F.pmod(F.xxhash64("pattern"), F.lit(buckets)))
    totals = materialize(placed.groupBy("source", "bucket").agg(F.count("*").alias("total")), "pattern-buckets")

    by_total = Window.partitionBy("source").orderBy(F.desc("total"), "bucket")
    largest = totals.withColumn("_rank", F.row_number().over(by_total)).filter(F.col("_rank") <= top_n).select("source", "bucket")
    seen = placed.join(largest, ["source", "bucket"]).groupBy("source", "pattern").agg(F.count("*").alias("n"))
    by_count = Window.partitionBy("source").orderBy(F.desc("n"))
    best = seen.withColumn("_rank", F.row_number().over(by_count)).filter(F.col("_rank") <= top_n)
    floors = best.groupBy("source").agg(F.min("n").alias("floor"))

    kept = materialize(totals.join(floors, "source").filter("total >= floor").select("source", "bucket"), "kept-buckets")
    counted = placed.join(kept, ["source", "bucket"]).groupBy("source", "pattern").agg(F.count("*").alias("n"), F.min("line_no").alias("first_no"))
    return _with_first_lines(lines, top_patterns(counted, ["source"], top_n))


def log_summary(lines: DataFrame) -> DataFrame:
    """Per source: non-blank lines, first and last timestamp in file order, distinct patterns.

    One pass over the lines: patterns are counted first, the few pattern rows then add up.
    """
    stamped = _log_patterns(lines).select(
        "source",
        "line_no",
        tx.mask_line(F.col("line")).alias("pattern"),
        tx.first_timestamp(F.col("line")).alias("ts"),
    )
    stamp_no = F.when(F.col("ts").isNotNull(), F.col("line_no"))
    per_pattern = stamped.groupBy("source", "pattern").agg(
        F.count("*").alias("n"),
        F.min(stamp_no).alias("first_no"),
        F.max(stamp_no).alias("last_no"),
        F.min_by("ts", stamp_no).alias("first_ts"),
        F.max_by("ts", stamp_no).alias("last_ts"),
    )
    return per_pattern.groupBy("source").agg(
        F.sum("n").alias("total_lines"),
        F.min_by("first_ts", "first_no").alias("first_ts"),
        F.max_by("last_ts", "last_no").alias("last_ts"),
        F.count("*").alias("distinct_patterns"),
    )
