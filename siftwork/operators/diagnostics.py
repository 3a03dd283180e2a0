"""Compiler diagnostics (SARIF): which lines are flagged, which may go, files without them.

A run is one build of one tree. Every table names it in `run_id`: logs (run_id, file_name, body),
sources (run_id, path, content BINARY), build lines and build runs. Runs never mix, also where they
hold the same path or project.

Joins with the sources carry a merge hint: contents are larger than the scan they are estimated by, and a
broadcast of them would not fit the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions import paths
from siftwork.functions import text as tx
from siftwork.operators.runs import build_failed
from siftwork.sources.checkpoints import materialize

# As the only element of an array, so that text behind the object is noticed.
SARIF_SCHEMA = """
    array<struct<runs: array<struct<results: array<struct<
        ruleId: string,
        suppressions: array<struct<kind: string>>,
        locations: array<struct<physicalLocation: struct<
            artifactLocation: struct<uri: string>,
            region: struct<startLine: bigint, endLine: bigint>>>>>>>>>>
"""

# Fixed value: the rule whose diagnostics mark unnecessary directives.
RULE = "IDE0005"

KEYS = ["run_id", "path"]

# No file that fits in a row has more lines.
MOST_LINES = 2**31 - 1
_CHUNK = 1 << 16

# The three bytes of a UTF-8 byte order mark, each read as one character.
BYTES_BOM = "\xef\xbb\xbf"
DIRECTIVE = f"^(?:{BYTES_BOM})?[ \\t]*(?:global[ \\t]+)?using[ \\t]+[^;{{}}()\\r\\n]+;[ \\t]*(?://[^\\r\\n]*)?\\z"


def _context(file_name: Column) -> tuple[Column, Column]:
    """Project (with its hash) and target framework from `Name_framework_hash.sarif`."""
    name = F.left(file_name, F.length(file_name) - len(".sarif"))
    ending = F.substring_index(name, "_", -2)
    project = F.left(name, F.length(name) - F.length(ending) - 1)
    with_hash = F.concat_ws("_", project, F.substring_index(ending, "_", -1))
    return with_hash.alias("project"), F.substring_index(ending, "_", 1).alias("tfm")


def _logs(sarif: DataFrame) -> DataFrame:
    return sarif.filter(F.col("file_name").endswith(".sarif"))


def sarif_contexts(sarif: DataFrame) -> DataFrame:
    """Every compilation seen, also those without results: (run_id, project, tfm)."""
    return _logs(sarif).select("run_id", *_context(F.col("file_name"))).distinct()


def read_logs(sarif: DataFrame, rule: str = RULE) -> DataFrame:
    """Each log parsed once: (run_id, file_name, project, tfm, sound, runs).

    `sound` tells whether the body is one JSON object with nothing behind it; `runs` are its results
    as far as they are read here, NULL where the body does not name the rule.
    """
    parsed = F.from_json(F.concat(F.lit("["), tx.without_bom(F.col("body")), F.lit("]")), SARIF_SCHEMA)

    def judged(objects: Column) -> Column:
        sound = F.coalesce((F.size(objects) == 1) & F.get(objects, F.lit(0)).isNotNull(), F.lit(False))
        return F.struct(sound.alias("sound"), F.when(sound, F.get(objects, F.lit(0))["runs"]).alias("runs"))

    read = _logs(sarif).select("run_id", "file_name", *_context(F.col("file_name")), "body", tx.bind(parsed, judged).alias("_log"))
    named = F.when(F.contains("body", F.lit(rule)), F.col("_log.runs"))
    return read.select("run_id", "file_name", "project", "tfm", "_log.sound", named.alias("runs"))


def unreadable_logs(sarif: DataFrame) -> DataFrame:
    """Logs that are no JSON object: (run_id, file_name)."""
    return _logs(sarif).filter(~tx.is_json_object(F.col("body"))).select("run_id", "file_name")


def sarif_spans(sarif: DataFrame, rule: str = RULE) -> DataFrame:
    """Flagged spans of own code: (run_id, path, start, end, project, tfm)."""
    return _spans(read_logs(sarif.filter(F.contains("body", F.lit(rule))), rule), rule)


def _spans(logs: DataFrame, rule: str) -> DataFrame:
    def place(location: Column) -> Column:
        at = location["physicalLocation"]
        start = at["region"]["startLine"]
        return F.struct(
            paths.uri_to_path(F.coalesce(at["artifactLocation"]["uri"], F.lit(""))).alias("path"),
            start.alias("start"),
            F.least(F.coalesce(at["region"]["endLine"], start), F.lit(MOST_LINES)).alias("end"),
        )

    live = lambda result: (result["ruleId"] == rule) & (F.coalesce(F.size(result["suppressions"]), F.lit(0)) <= 0)
    # A log's live results in one array, places decoded there: one explode, and no filter that decodes again.
    results = F.filter(F.flatten(F.transform(F.filter("runs", lambda run: run["results"].isNotNull()), lambda run: run["results"])), live)
    spots = F.flatten(F.transform(F.filter(results, lambda r: r["locations"].isNotNull()), lambda r: F.transform(r["locations"], place)))
    placed = logs.select("run_id", "project", "tfm", F.explode(spots).alias("_at")).select("run_id", "project", "tfm", "_at.*")
    own_code = F.lower("path").endswith(".cs") & ~F.col("path").rlike(r"(?i)[\\/](?:obj|bin)[\\/]")
    return placed.filter(own_code & (F.col("end") >= F.col("start"))).select(
        "run_id", paths.normalize(F.col("path")).alias("path"), F.greatest("start", F.lit(0)).alias("start"), "end", "project", "tfm"
    ).filter(F.col("end") >= F.col("start"))


def span_lines(spans: DataFrame) -> DataFrame:
    """One row per line of each span: (run_id, path, line_no, project, tfm). Long spans unfold piece by piece."""
    pieces = spans.select("*", F.explode(F.sequence("start", "end", F.lit(_CHUNK).cast("bigint"))).alias("_from"))
    lines = F.sequence("_from", F.least(F.col("end"), F.col("_from") + (_CHUNK - 1)))
    return pieces.select("run_id", "path", F.explode(lines).alias("line_no"), "project", "tfm").distinct()


def sarif_diagnostics(sarif: DataFrame, rule: str = RULE) -> DataFrame:
    """Flagged lines, one row per compilation that flags them: (run_id, path, line_no, project, tfm)."""
    return span_lines(sarif_spans(sarif, rule))


def select_removable(diagnostics: DataFrame, contexts: DataFrame) -> DataFrame:
    """(run_id, path, line_no, status): removable when every project that flags the line flags it in
    every framework it compiled, else partial."""
    compiled = contexts.groupBy("run_id", "project").agg(F.count("*").alias("compiled"))
    flagged = diagnostics.groupBy(*KEYS, "line_no", "project").agg(F.count("*").alias("flagged"))
    covered = flagged.join(compiled.hint("merge"), ["run_id", "project"]).groupBy(*KEYS, "line_no").agg(
        F.bool_and(F.col("flagged") == F.col("compiled")).alias("_all")
    )
    return covered.select(*KEYS, "line_no", F.when(F.col("_all"), "removable").otherwise("partial").alias("status"))


def _lines_of(content: Column) -> Column:
    """The lines of BINARY content, one character per byte, terminators left out."""
    return tx.text_lines(F.decode(content, "ISO-8859-1"))


def line_counts(files: DataFrame) -> DataFrame:
    """(run_id, path, n_lines)."""
    return files.select(*KEYS, F.size(_lines_of(F.col("content"))).cast("bigint").alias("n_lines"))


def is_directive(line: Column) -> Column:
    return line.rlike(DIRECTIVE)


def keep_directive_lines(flagged: DataFrame, files: DataFrame) -> DataFrame:
    """Flagged lines (run_id, path, line_no, ...) that really are directives, with their `line`.

    Blank and comment lines of a span go, and lines outside the file. A file's flagged lines, no
    more than it has lines, meet its content once; other files are not split.
    """
    rest = [c for c in flagged.columns if c not in KEYS]
    inside = flagged.join(line_counts(files).hint("merge"), KEYS).filter((F.col("line_no") >= 1) & (F.col("line_no") <= F.col("n_lines")))
    wanted = inside.groupBy(*KEYS).agg(F.collect_list(F.struct(*rest)).alias("_wanted"))

    def texts(lines: Column) -> Column:
        return F.transform("_wanted", lambda x: F.struct(x.alias("at"), F.get(lines, (x["line_no"] - 1).cast("int")).alias("line")))

    found = files.hint("merge").join(wanted, KEYS).select(*KEYS, F.explode(tx.bind(_lines_of(F.col("content")), texts)).alias("_f"))
    directives = found.filter(is_directive(F.col("_f.line")))
    return directives.select(*KEYS, "_f.at.*", F.regexp_replace("_f.line", f"^{BYTES_BOM}", "").alias("line"))


def remove_lines(files: DataFrame, flagged: DataFrame) -> DataFrame:
    """Files with flagged lines: (run_id, path, content BINARY, removed, skipped, outside).

    `removed` and `skipped` are line numbers of the file: directives that went, and flagged lines
    that are none. `outside` counts flagged lines that the file does not have. Bytes other than the
    removed lines stay; a mark that opens line 1 stays too.
    """
    # Of files that repeat a path the longest bounds the list; each then looks at its own lines.
    longest = line_counts(files).groupBy(*KEYS).agg(F.max("n_lines").alias("n_lines"))
    wanted = flagged.select(*KEYS, "line_no").distinct().join(longest.hint("merge"), KEYS)
    inside = (F.col("line_no") >= 1) & (F.col("line_no") <= F.col("n_lines"))
    numbers = wanted.groupBy(*KEYS).agg(
        F.array_sort(F.collect_list(F.when(inside, F.col("line_no")))).alias("_wanted"), F.count_if(~inside).alias("_beyond")
    )

    def judge(lines: Column) -> Column:
        own = F.filter("_wanted", lambda n: n <= F.size(lines))
        return F.struct(
            own.alias("own"), F.filter(own, lambda n: is_directive(F.get(lines, (n - 1).cast("int")))).alias("removed"),
            (F.col("_beyond") + F.size(F.filter("_wanted", lambda n: n > F.size(lines)))).alias("outside"),
        )

    text = F.decode("content", "ISO-8859-1")
    judged = files.hint("merge").join(numbers, KEYS).select(
        *KEYS, text.alias("_text"), tx.bind(_lines_of(F.col("content")), judge).alias("_j")
    ).select(*KEYS, "_text", F.col("_j.own").alias("_wanted"), "_j.removed", "_j.outside")

    def kept(pieces: Column) -> Column:
        """What lies between the removed lines, in order."""
        edges = F.concat(F.array(F.lit(0).cast("bigint")), "removed", F.array(F.size(pieces).cast("bigint") + 1))

        def between(bounds: Column) -> Column:
            return F.transform(
                F.sequence(F.lit(0), F.size("removed")),
                lambda j: F.slice(pieces, (bounds[j] + 1).cast("int"), (bounds[j + 1] - bounds[j] - 1).cast("int")),
            )

        return F.array_join(F.flatten(tx.bind(edges, between)), "")

    mark = F.when((F.get("removed", F.lit(0)) == 1) & F.startswith("_text", F.lit(BYTES_BOM)), BYTES_BOM).otherwise("")
    left = F.concat(mark, tx.bind(F.split("_text", r"(?<=\n)|(?<=\r)(?!\n)"), kept))
    return judged.select(
        *KEYS, F.encode(left, "ISO-8859-1").alias("content"), "removed", F.array_except("_wanted", "removed").alias("skipped"), "outside"
    )


def prune_report(
    sarif: DataFrame, sources: DataFrame, build_lines: DataFrame, build_runs: DataFrame, rule: str = RULE
) -> DataFrame:
    """Per file the directive lines that may go or must stay: (run_id, path, status, lines).

    The logs are parsed once and written. A run whose build failed, or one of whose logs cannot be read, has no rows: its diagnostics
    would be incomplete. `prune_status` has a row for every run.
    """
    logs = materialize(read_logs(sarif, rule), "logs")
    failed = build_failed(build_lines, build_runs, rule).filter("failed").select("run_id")
    incomplete = failed.unionByName(logs.filter("not sound").select("run_id")).distinct()
    spans = _spans(logs, rule).join(incomplete, "run_id", "left_anti").join(line_counts(sources).hint("merge"), KEYS)
    clipped = spans.withColumn("end", F.least("end", "n_lines")).filter("end >= start")
    status = select_removable(span_lines(clipped), logs.select("run_id", "project", "tfm").distinct())
    return keep_directive_lines(status, sources).groupBy(*KEYS, "status").agg(F.count("*").alias("lines"))


def prune_status(
    report: DataFrame, sarif: DataFrame, build_lines: DataFrame, build_runs: DataFrame, rule: str = RULE
) -> DataFrame:
    """One row per run: (run_id, status, error_lines, lines) with `lines` that may go by `prune_report`."""
    unread = unreadable_logs(sarif).groupBy("run_id").agg(F.count("*").alias("_unread"))
    seen = _logs(sarif).groupBy("run_id").agg(F.count("*").alias("_seen"))
    found = report.filter("status = 'removable'").groupBy("run_id").agg(F.sum("lines").alias("lines"))
    joined = build_failed(build_lines, build_runs, rule).join(seen, "run_id", "left").join(unread, "run_id", "left").join(found, "run_id", "left")
    status = (
        F.when(F.col("failed"), "build failed")
        .when(F.col("_seen").isNull(), "no compilation seen")
        .when(F.col("_unread").isNotNull(), "unreadable log")
        .when(F.col("lines").isNull(), "nothing unnecessary")
        .otherwise("lines found")
    )
    return joined.select("run_id", status.alias("status"), "error_lines", F.coalesce("lines", F.lit(0)).alias("lines"))
