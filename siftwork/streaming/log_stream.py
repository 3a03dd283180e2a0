"""Log patterns per window of event time: counted while lines arrive, final once the watermark passes.

Lines may come in any order and from any number of files. A window stays open until the newest
timestamp seen is `delay` past its end; then its patterns are written once and its state goes. The state
holds one row per pattern of an open window, however many lines there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftwork.functions import text as tx
from siftwork.operators.lines import top_patterns

WINDOW, DELAY = "1 day", "6 hours"


def window_patterns(lines: DataFrame, window: str = WINDOW, delay: str = DELAY) -> DataFrame:
    """(source, window_start, window_end, pattern, n, first_no, line) from (source, ts, line_no, line).

    A table gives every window, a stream in append mode only those that the watermark has passed. Blank lines
    and lines without a timestamp count nowhere.
    """
    counted = lines.filter(~tx.is_blank(F.col("line"))).withWatermark("ts", delay)
    return (
        counted.groupBy("source", F.window("ts", window).alias("_w"), tx.mask_line(F.col("line")).alias("pattern"))
        .agg(F.count("*").alias("n"), F.min("line_no").alias("first_no"), F.min_by("line", "line_no").alias("line"))
        .select("source", F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "pattern", "n", "first_no", "line")
    )


def write_window_patterns(
    lines: DataFrame, sink: str, checkpoint: str, window: str = WINDOW, delay: str = DELAY, **trigger: object
) -> StreamingQuery:
    """Follows a stream of lines and adds the patterns of each closed window to the folder `sink`, exactly once.

    Open windows stay in `checkpoint`, from where a restart goes on. Lines of a window that is
    closed already are left out (`late_lines` counts them). `trigger` is passed on; without it, what there is
    now is read and the query ends.
    """
    return (
        window_patterns(lines, window, delay)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start(sink)
    )


def top_window_patterns(patterns: DataFrame, top_n: int = 25) -> DataFrame:
    """Per source and window the `top_n` most frequent patterns, with `rank`; ties in order of first appearance."""
    return top_patterns(patterns, ["source", "window_start"], top_n)


def late_lines(lines: DataFrame, patterns: DataFrame, window: str = WINDOW) -> DataFrame:
    """(source, window_start, lines, late): of every closed window all its lines and those that came too late to count.

    `lines` is the table of all lines that the stream has read, `patterns` what it wrote. Closed windows alone
    of which every line came late are not among them.
    """
    seen = lines.filter(~tx.is_blank(F.col("line"))).groupBy("source", F.window("ts", window)["start"].alias("window_start")).agg(F.count("*").alias("lines"))
    counted = patterns.groupBy("source", "window_start").agg(F.sum("n").alias("_n"))
    return seen.join(counted, ["source", "window_start"]).select("source", "window_start", "lines", (F.col("lines") - F.col("_n")).alias("late"))
