"""Build and test runs: line classes, totals, failures, per-run digests.

Runs come as (run_id, exit_code[, output]); lines as (run_id, line_no, line). Lines of a run
spread over many partitions; nothing here gathers a whole run in one task.
"""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.functions import text as tx
from siftwork.operators.lines import dedupe_lines, to_lines, top_patterns

D, W, S = tx.DIGIT, tx.WORD, tx.SPACE

# The words and phrases test runners use.
FAILURE_WORDS = ("failed", "fail:", "error", "traceback", "\u2717", "\u2718")
SUMMARY_LINE = (
    f"{D}+ (?:passed|failed|skipped|errors?){tx.WORD_END}"
    f"|Tests:{S}*{D}+|Test Suites:|{W}!{S}+-{S}+Failed:{S}*{D}+|Test summary:|Test run summary:"
    f"|^Ran {D}+ tests? in |^{S}*(?:total|failed|succeeded|skipped):{S}*{D}+{S}*$"
)


def run_lines(runs: DataFrame) -> DataFrame:
    """(run_id, line_no, line) of captured outputs."""
    return to_lines(runs, ["run_id"], "output", "captured")


# --- builds ---------------------------------------------------------------------------------


def line_class(line: Column) -> Column:
    lowered = F.lower(line)
    return (
        F.when(F.contains(lowered, F.lit("error")), "error")
        .when(F.contains(lowered, F.lit("warn")), "warning")
        .otherwise("other")
    )


def classify_build_lines(lines: DataFrame) -> DataFrame:
    """Lines with `class`: error (wins), warning or other."""
    return lines.withColumn("class", line_class(F.col("line")))


def build_patterns(lines: DataFrame) -> DataFrame:
    """Masked error and warning lines counted per run."""
    marked = classify_build_lines(lines).filter(F.col("class") != "other")
    return dedupe_lines(marked.withColumn("line", tx.strip(F.col("line"))), ["run_id", "class"])


def build_top_patterns(lines: DataFrame, limit: int | None = None) -> DataFrame:
    """Errors and warnings of each run by frequency, the top `limit` of each if given: (run_id, class, rank, n, line)."""
    ranked = top_patterns(build_patterns(lines), ["run_id", "class"], limit)
    return ranked.select("run_id", "class", "rank", "n", "line")


def last_lines(lines: DataFrame, n: int) -> DataFrame:
    """The last `n` lines of each run as one ordered array: (run_id, last_lines).

    Every partition is cut to `n` lines per run before the shuffle; joining the lines with the
    runs of interest instead would send all of them through it.
    """
    newest = Window.partitionBy("run_id").orderBy(F.desc("line_no"))
    tail = lines.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= n)
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return tail.groupBy("run_id").agg(F.transform(ordered, lambda x: x["line"]).alias("last_lines"))


def _with_last_lines(digest: DataFrame, unnamed: DataFrame, last: int) -> DataFrame:
    """Adds the `last` last lines where the status is a failure without a cause.

    Such a run has none but `unnamed` lines of failed runs, so the others are not ranked.
    """
    failed = digest.filter(F.col("exit_code") != 0).select("run_id")
    joined = digest.join(last_lines(unnamed.join(failed, "run_id", "left_semi"), last), "run_id", "left")
    return joined.withColumn("last_lines", F.when(F.col("status").startswith("non-zero"), F.col("last_lines")))


def build_digest(lines: DataFrame, runs: DataFrame, last: int = 20) -> DataFrame:
    """One row per run: exit code, line and pattern counts per class, status, last lines.

    `last_lines` is filled only where a failed run shows no error or warning line.
    """
    patterns = build_patterns(lines)
    is_error = F.col("class") == "error"
    counts = patterns.groupBy("run_id").agg(
        F.sum(F.when(is_error, F.col("n"))).alias("error_lines"),
        F.count(F.when(is_error, 1)).alias("error_patterns"),
        F.sum(F.when(~is_error, F.col("n"))).alias("warning_lines"),
        F.count(F.when(~is_error, 1)).alias("warning_patterns"),
    )
    counted = ["error_lines", "error_patterns", "warning_lines", "warning_patterns"]
    joined = runs.select("run_id", "exit_code").join(counts, "run_id", "left").fillna(0, counted)
    nothing_found = (F.col("error_lines") == 0) & (F.col("warning_lines") == 0)
    status = (
        F.when(~nothing_found, "issues found")
        .when(F.col("exit_code") == 0, "build clean")
        .otherwise("non-zero exit, no recognizable error lines")
    )
    return _with_last_lines(joined.withColumn("status", status), lines.filter(line_class(F.col("line")) == "other"), last)


def build_error_line(line: Column, rule: str) -> Column:
    """A compiler or package error line, unless it reports the rule under study."""
    return line.rlike(rf"(?i):{S}*error{S}*(?:(?!{rule}{tx.WORD_END})[A-Z]+{D}+{S}*)?:")


def build_failed(lines: DataFrame, runs: DataFrame, rule: str = "IDE0005") -> DataFrame:
    """(run_id, exit_code, error_lines, failed): failed needs a bad exit and an error line."""
    errors = lines.filter(build_error_line(F.col("line"), rule)).groupBy("run_id").agg(F.count("*").alias("error_lines"))
    joined = runs.select("run_id", "exit_code").join(errors, "run_id", "left").fillna(0, ["error_lines"])
    return joined.withColumn("failed", (F.col("exit_code") != 0) & (F.col("error_lines") > 0))


# --- tests ----------------------------------------------------------------------------------


def is_summary_line(line: Column) -> Column:
    return line.rlike(SUMMARY_LINE)


def is_failure_line(line: Column) -> Column:
    lowered = F.lower(line)
    named = reduce(or_, [F.contains(lowered, F.lit(word)) for word in FAILURE_WORDS])
    return named & ~is_summary_line(line)


def failure_patterns(lines: DataFrame) -> DataFrame:
    failing = lines.filter(is_failure_line(F.col("line")))
    return dedupe_lines(failing.withColumn("line", tx.strip(F.col("line"))), ["run_id"])


def test_failure_lines(lines: DataFrame, limit: int | None = None) -> DataFrame:
    """Failure patterns of each run by frequency, the top `limit` if given: (run_id, rank, n, line)."""
    return top_patterns(failure_patterns(lines), ["run_id"], limit).select("run_id", "rank", "n", "line")


def test_summary_lines(lines: DataFrame, limit: int | None = None) -> DataFrame:
    """The summary lines of each run, the last `limit` if given: (run_id, line_no, line)."""
    if limit is None:
        return lines.filter(is_summary_line(F.col("line"))).select("run_id", "line_no", "line")
    newest = Window.partitionBy("run_id").orderBy(F.desc("line_no"))
    found = lines.filter(is_summary_line(F.col("line")))
    ranked = found.withColumn("_rank", F.row_number().over(newest))
    return ranked.filter(F.col("_rank") <= limit).select("run_id", "line_no", "line")


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


_DIGITS = "".join(chr(c) for c in range(128, 0x20000) if unicodedata.category(chr(c)) == "Nd")
_VALUES = "".join(str(unicodedata.digit(c)) for c in _DIGITS)


def _whole(digits: Column) -> Column:
    """Digits of any script as a number; NULL where it does not fit."""
    return F.translate(digits, _DIGITS, _VALUES).try_cast("bigint")


def _numbers(hit: Column, pattern: str, names: list[str]) -> dict[str, Column]:
    return {n: _whole(F.regexp_extract(hit, pattern, i + 1)) for i, n in enumerate(names)}


def _totals(passed: Column, failed: Column, skipped: Column, total: Column | None, source: Column) -> Column:
    total = passed + failed + skipped if total is None else total
    return F.struct(
        passed.alias("passed"), failed.alias("failed"), skipped.alias("skipped"),
        total.alias("total"), source.alias("format"),
    )


def _from_words(words: Column, source: str) -> Column:
    """Totals from `3 passed, 1 xfailed` style text."""
    pairs = tx.extract_pairs(words, f"({D}+) ({W}+)", "count", "word")

    def of(*names: str) -> Column:
        hits = F.filter(pairs, lambda p: F.lower(p["word"]).isin(*names))
        return F.aggregate(hits, F.lit(0).cast("bigint"), lambda acc, p: acc + _whole(p["count"]))

    passed, failed = of("passed", "xpassed"), of("failed", "error", "errors")
    skipped = of("skipped", "xfailed", "todo")
    stated = F.when(F.exists(pairs, lambda p: F.lower(p["word"]) == "total"), of("total"))
    return _totals(passed, failed, skipped, F.coalesce(stated, passed + failed + skipped), F.lit(source))


def _last_or_null(hits: Column, body) -> Column:
    return tx.bind(hits, lambda h: F.when(F.size(h) > 0, body(F.element_at(h, -1))))


def _dotnet_aggregate(output: Column) -> Column:
    number = f"{S}*({D}+)"
    pattern = f"(?i)Test summary:{S}*total:{number},{S}*failed:{number},{S}*succeeded:{number},{S}*skipped:{number}"

    def totals(hit: Column) -> Column:
        n = _numbers(hit, pattern, ["total", "failed", "passed", "skipped"])
        return _totals(n["passed"], n["failed"], n["skipped"], n["total"], F.lit("dotnet"))

    return _last_or_null(_all(output, pattern, 0), totals)


def _dotnet_block(output: Column) -> Column:
    # "blanks, a line end, blanks" is written so that it can match in one way only.
    next_line = f"{tx.INLINE_SPACE}*\\n{S}*"
    pattern = (
        f"(?imd)^{tx.INLINE_SPACE}*total:{S}*({D}+){next_line}failed:{S}*({D}+)"
        f"{next_line}succeeded:{S}*({D}+){next_line}skipped:{S}*({D}+)"
    )

    def totals(hit: Column) -> Column:
        n = _numbers(hit, pattern, ["total", "failed", "passed", "skipped"])
        return _totals(n["passed"], n["failed"], n["skipped"], n["total"], F.lit("dotnet-mtp"))

    return _last_or_null(_all(output, pattern, 0), totals)


def _vstest_assemblies(output: Column) -> Column:
    number = f"{S}*({D}+)"
    pattern = f"{W}!{S}+-{S}+Failed:{number},{S}*Passed:{number},{S}*Skipped:{number},{S}*Total:{number}"

    def sums(hits: Column) -> Column:
        def total_of(group: int) -> Column:
            add = lambda acc, h: acc + _whole(F.regexp_extract(h, pattern, group))
            return F.aggregate(hits, F.lit(0).cast("bigint"), add)

        source = F.concat(F.lit("vstest x"), F.size(hits).cast("string"), F.lit(" assemblies"))
        return F.when(F.size(hits) > 0, _totals(total_of(2), total_of(1), total_of(3), total_of(4), source))

    return tx.bind(_all(output, pattern, 0), sums)


def _jest(output: Column) -> Column:
    hits = _all(output, f"(?md)^Tests:{S}+(.*{D}+ total)", 1)
    return _last_or_null(hits, lambda words: _from_words(words, "jest"))


def _unittest(output: Column) -> Column:
    ran = _all(output, f"(?md)^Ran ({D}+) tests? in ", 1)
    result_pattern = f"(?md)^(?:OK|FAILED)(?: \\(([^)]*)\\))?{S}*$"
    results = _all(output, result_pattern, 0)

    def totals(hit: Column, total: Column) -> Column:
        pairs = tx.extract_pairs(F.regexp_extract(hit, result_pattern, 1), f"({W}+)=({D}+)", "key", "count")

        def of(name: str) -> Column:
            found = F.filter(pairs, lambda p: p["key"] == name)
            return F.when(F.size(found) > 0, _whole(F.element_at(found, -1)["count"])).otherwise(F.lit(0))

        failed = of("failures") + of("errors") + of("unexpected_successes")
        skipped = of("skipped") + of("expected_failures")
        return _totals(total - failed - skipped, failed, skipped, total, F.lit("unittest"))

    both = F.struct(ran.alias("ran"), results.alias("results"))
    return tx.bind(
        both,
        lambda b: F.when(
            (F.size(b["ran"]) > 0) & (F.size(b["results"]) > 0),
            totals(F.element_at(b["results"], -1), _whole(F.element_at(b["ran"], -1))),
        ),
    )


def _pytest(output: Column) -> Column:
    # A count and a word, and again, glued by ", " or by a word that ends in the next count.
    # Every repeat has one way to match and gives nothing back, so that long rows of plain
    # numbers neither make the search explode nor exhaust the stack.
    end = f"in {D}+(?:\\.{D}+)?s"
    chunk = f"{D}+ (?:{W}+{D} (?!{end}))*+{W}++"
    pattern = f"(?md)^[={tx.INLINE_SPACE}]*({chunk}(?:, {chunk})*+(?:, )?) {end}"
    return _last_or_null(_all(output, pattern, 1), lambda words: _from_words(words, "pytest"))


def parse_totals(output: Column) -> Column:
    """STRUCT(passed, failed, skipped, total, format), NULL when no runner is recognized.

    Whole-run summaries come before per-assembly ones; the first format found decides.
    """
    lowered = F.lower(output)

    def where(text: Column, needle: str, parsed: Column) -> Column:
        # A plain search first: most outputs hold one format, regexes for the others are wasted.
        return F.when(F.contains(text, F.lit(needle)), parsed)

    return F.coalesce(
        where(lowered, "test summary:", _dotnet_aggregate(output)),
        where(lowered, "succeeded:", _dotnet_block(output)),
        where(output, "Failed:", _vstest_assemblies(output)),
        where(output, "Tests:", _jest(output)),
        where(output, "Ran ", _unittest(output)),
        where(output, " in ", _pytest(output)),
    )


def test_totals(runs: DataFrame) -> DataFrame:
    """(run_id, exit_code, passed, failed, skipped, total, format); NULLs when not recognized."""
    return runs.select("run_id", "exit_code", parse_totals(F.col("output")).alias("_t")).select(
        "run_id", "exit_code", "_t.passed", "_t.failed", "_t.skipped", "_t.total", "_t.format"
    )


def test_digest(runs: DataFrame, lines: DataFrame | None = None, summaries: int = 5, last: int = 20) -> DataFrame:
    """Totals, failure counts, the last `summaries` summary lines and status, one row per run.

    Status is `no failures detected` only without failure lines and with exit code 0.
    """
    lines = run_lines(runs) if lines is None else lines
    failures = failure_patterns(lines).groupBy("run_id").agg(
        F.sum("n").alias("failure_lines"), F.count("*").alias("failure_patterns")
    )
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    summary = test_summary_lines(lines, summaries).groupBy("run_id").agg(
        F.transform(ordered, lambda x: x["line"]).alias("summary_lines")
    )
    counted = ["failure_lines", "failure_patterns"]
    joined = test_totals(runs).join(failures, "run_id", "left").join(summary, "run_id", "left").fillna(0, counted)
    status = (
        F.when(F.col("failure_lines") > 0, "failures")
        .when(F.col("exit_code") == 0, "no failures detected")
        .otherwise("non-zero exit, no recognizable failure lines")
    )
    return _with_last_lines(joined.withColumn("status", status), lines.filter(~is_failure_line(F.col("line"))), last)
