"""Repository artifacts: files, symbols, markers, likely secrets, manifests, diffs, status.

Files come as (repo, path, content STRING). Whatever concerns one file is computed inside its
row, so those operators add no shuffle; only counts and top lists per repository do.
"""

from __future__ import annotations

import ast
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from siftwork.functions import paths
from siftwork.functions import text as tx
from siftwork.operators.lines import to_lines
from siftwork.operators.ranks import ranked_within
from siftwork.operators.runs import build_digest, test_digest

S, W = tx.SPACE, tx.WORD

# Marker words in report order, skipped file types.
MAX_COMMITS = 5
MARKERS = ("FIXME", "HACK", "XXX", "TODO")
BINARY_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".ico", ".pdf", ".zip", ".exe", ".dll", ".pyc")
JS_EXTENSIONS = (".js", ".ts", ".jsx", ".tsx")


# --- inventory and symbols ------------------------------------------------------------------


def tracked_files(files: DataFrame) -> DataFrame:
    """Files outside build, cache and hidden folders."""
    path = F.col("path")
    return files.filter(~paths.in_any_folder(path, paths.SOURCE_TREE_EXCLUDES) & ~paths.in_hidden_folder(path))


def file_inventory(files: DataFrame) -> DataFrame:
    """(repo, file_count)."""
    return files.groupBy("repo").agg(F.count("*").alias("file_count"))


def file_paths(files: DataFrame) -> DataFrame:
    """(repo, path) of every file; the caller orders them."""
    return files.select("repo", "path")


@F.pandas_udf(ArrayType(StringType()))
def _python_definitions(content: pd.Series) -> pd.Series:
    def names(source: str | None) -> list[str]:
        if source is None:
            return []
        try:
            body = ast.parse(source).body
        except Exception:  # any unparsable file simply has no symbols
            return []
        return [n.name for n in body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]

    return content.map(names)


def _js_definitions(content: Column) -> Column:
    lead = f"(?md)^{tx.INLINE_SPACE}*(?:export{S}+)?(?:default{S}+)?(?:async{S}+)?(?:function|class){S}+({W}+)"
    return F.regexp_extract_all(content, F.lit(lead), F.lit(1))


def python_symbols(files: DataFrame) -> DataFrame:
    """Top-level functions and classes of .py files: (repo, path, pos, symbol)."""
    python = files.filter(paths.extension(F.col("path")) == ".py")
    return _symbol_rows(python.select("repo", "path", _python_definitions("content").alias("_symbols")))


def js_symbols(files: DataFrame) -> DataFrame:
    """Functions and classes that open a line of a JavaScript or TypeScript file."""
    scripts = files.filter(paths.extension(F.col("path")).isin(*JS_EXTENSIONS))
    return _symbol_rows(scripts.select("repo", "path", _js_definitions(F.col("content")).alias("_symbols")))


def _symbol_rows(df: DataFrame) -> DataFrame:
    rows = df.select("repo", "path", F.posexplode("_symbols").alias("_pos", "symbol"))
    return rows.select("repo", "path", (F.col("_pos") + 1).cast("bigint").alias("pos"), "symbol")


def repo_map(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Every file with its symbols, the first `limit` if given: (repo, path, symbols ARRAY<STRING>)."""
    ext = paths.extension(F.col("path"))
    # A NULL goes to the Python workers for files that are no Python, never their content.
    python = _python_definitions(F.when(ext == ".py", F.col("content")))
    symbols = F.when(ext.isin(*JS_EXTENSIONS), _js_definitions(F.col("content"))).otherwise(python)
    return files.select("repo", "path", (symbols if limit is None else F.slice(symbols, 1, limit)).alias("symbols"))


# --- markers --------------------------------------------------------------------------------


def markers_in_lines(lines: DataFrame, keep: list[str], length: int | None = None) -> DataFrame:
    """The first marker of each line: (keep..., line_no, marker, text), text cut to `length` if given."""
    word = f"{tx.WORD_START}(TODO|FIXME|HACK|XXX){tx.WORD_END}[:{tx.SPACE_SET}]?([^\\n]*)"
    hit = F.regexp_extract("line", word, 0)
    text = tx.strip(F.regexp_extract("_hit", word, 2))
    return (
        lines.filter(reduce(or_, [F.contains("line", F.lit(m)) for m in MARKERS]))
        .withColumn("_hit", hit)
        .filter(F.col("_hit") != "")
        .select(
            *keep,
            "line_no",
            F.regexp_extract("_hit", word, 1).alias("marker"),
            (text if length is None else F.substring(text, 1, length)).alias("text"),
        )
    )


def todo_markers(files: DataFrame, length: int | None = None) -> DataFrame:
    """TODO, FIXME, HACK and XXX notes of text files: (repo, path, line_no, marker, text)."""
    is_text = ~F.lower(paths.extension(F.col("path"))).isin(*BINARY_EXTENSIONS)
    inside = ~paths.in_any_folder(F.col("path"), paths.SOURCE_TREE_EXCLUDES)
    marked = reduce(or_, [F.contains("content", F.lit(m)) for m in MARKERS])
    lines = to_lines(files.filter(is_text & inside & marked), ["repo", "path"], "content")
    return markers_in_lines(lines, ["repo", "path"], length)


def todo_summary(markers: DataFrame, limit: int | None = None) -> DataFrame:
    """Items with the counts of their repository and marker, one row each.

    (repo, rank, marker, marker_count, repo_count, path, line_no, text); with `limit` only the first
    items of each marker in file order.
    """
    counts = markers.groupBy("repo", "marker").agg(F.count("*").alias("marker_count"))
    totals = counts.groupBy("repo").agg(F.sum("marker_count").alias("repo_count"))
    rank = F.array_position(F.array(*[F.lit(m) for m in MARKERS]), F.col("marker"))
    if limit is not None:
        order = Window.partitionBy("repo", "marker").orderBy("path", "line_no")
        markers = markers.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= limit)
    joined = markers.join(counts, ["repo", "marker"]).join(totals, "repo")
    return joined.select("repo", rank.alias("rank"), "marker", "marker_count", "repo_count", "path", "line_no", "text")


# --- likely secrets -------------------------------------------------------------------------

# rule -> (needles of which a text must hold one, lower case; pattern whose group 1 is the value).
# Each pattern starts with something rare, so that long lines without a finding stay cheap.
SECRET_RULES: dict[str, tuple[tuple[str, ...], str]] = {
    "aws_access_key": (("akia", "asia"), r"\b((?:AKIA|ASIA)[0-9A-Z]{16})\b"),
    "github_token": (("ghp_", "gho_", "ghs_", "ghu_", "github_pat_"), r"\b((?:gh[posu]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{40,}))\b"),
    "google_api_key": (("aiza",), r"\b(AIza[0-9A-Za-z_-]{35})"),
    "slack_token": (("xox",), r"\b(xox[abprs]-[0-9A-Za-z-]{10,})"),
    "stripe_key": (("sk_live_", "rk_live_"), r"\b((?:sk|rk)_live_[0-9A-Za-z]{16,})"),
    "private_key": (("private key",), r"(-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----)"),
    "jwt": (("eyj",), r"\b(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"),
    "url_password": (("://",), r"://[^\s/:@]+:([^\s/@]{3,})@"),
    "connection_password": (("password", "pwd"), r"(?i);\s*(?:password|pwd)\s*=\s*([^;\s\"'()]{3,})(?:[;\"']|$)"),
    "assigned_secret": (
        ("key", "token", "secret", "passw", "pwd"),
        r"(?i)(?:api[_-]?key|access[_-]?key|auth[_-]?token|token|secret|passwd|password|pwd)[\"']?\s*[:=]\s*[\"']([^\"'\s]{8,})[\"']",
    ),
}

# Values that stand in for a secret are no finding.
PLACEHOLDER_VALUE = (
    r"(?i)^(?:<[^>]*>|\$\{[^}]*\}|\{\{.*\}\}|%[^%]+%|\*+|x+|\.+|change[_-]?me.*|your[_-].*|example.*|placeholder.*|dummy.*|password|secret|token|null|none)$"
)


def _needs(text: Column, needles: tuple[str, ...]) -> Column:
    """Whether the text holds a needle in any case; lowered once, not once per needle."""
    holds = lambda lowered: reduce(or_, [F.contains(lowered, F.lit(n)) for n in needles])
    return F.exists(F.array(F.lower(text)), holds)


# How much of a value is the public mark of its kind; passwords have none.
PUBLIC_PREFIX = {"aws_access_key": 4, "github_token": 4, "google_api_key": 4, "slack_token": 4, "stripe_key": 8, "private_key": 10, "jwt": 3}
SHORTEST_SHOWN = 12


def _masked(value: Column, shown: int) -> Column:
    lead = F.when(F.length(value) >= SHORTEST_SHOWN, F.substring(value, 1, shown)).otherwise("")
    return F.concat(lead, F.lit("***"), F.length(value).cast("string"))


def scan_secrets(texts: DataFrame, keep: list[str], text: str) -> DataFrame:
    """Likely secrets, value masked: (keep..., line_no, rule, nth, masked).

    `nth` is the match's place among the rule's matches in the line, from 1. Placeholders count as
    matches but are no findings. Texts and lines without any rule's needle are dropped by plain
    substring search before a regex runs.
    """
    every_needle = tuple(sorted({n for needles, _ in SECRET_RULES.values() for n in needles}))
    lines = to_lines(texts.filter(_needs(F.col(text), every_needle)), keep, text)

    def found(rule: str, needles: tuple[str, ...], pattern: str) -> Column:
        matches = F.regexp_extract_all("line", F.lit(pattern), F.lit(1))
        rows = F.transform(
            matches,
            lambda v, k: F.struct(
                F.lit(rule).alias("rule"), (k + 1).cast("bigint").alias("nth"), v.alias("value"), _masked(v, PUBLIC_PREFIX.get(rule, 0)).alias("masked")
            ),
        )
        return F.when(_needs(F.col("line"), needles), rows)

    findings = F.array_compact(F.array(*[found(rule, *spec) for rule, spec in SECRET_RULES.items()]))
    hit = F.col("_hit")
    return (
        lines.filter(_needs(F.col("line"), every_needle))
        .select(*keep, "line_no", F.explode(F.flatten(findings)).alias("_hit"))
        .filter((hit["value"] != "") & ~hit["value"].rlike(PLACEHOLDER_VALUE))
        .select(*keep, "line_no", hit["rule"].alias("rule"), hit["nth"].alias("nth"), hit["masked"].alias("masked"))
    )


BLOCK_MARK = r"-----(?:BEGIN|END) (?:[A-Z0-9]+ ){0,4}PRIVATE KEY(?: BLOCK)?-----"
LEAST_KEY = 48  # characters of the shortest encoded key


def scan_secret_blocks(texts: DataFrame, keep: list[str], text: str) -> DataFrame:
    """Private keys over any number of lines: (keep..., line_no, last_line_no, label, closed, n_chars).

    A block runs from a BEGIN line to the END line of the same label that follows it as the next mark; without
    one it is not closed and has no `last_line_no`. Line breaks may be written as `\\n`, and header lines may
    lead, so a key inside one line of JSON counts too. `n_chars` counts the encoded characters that lead the
    block; blocks with fewer than LEAST_KEY of them are placeholders and no findings. Work stays in the row
    and grows with the text's length; null texts have no findings.
    """
    def in_line(line: Column, i: Column) -> Column:
        marks = F.transform(F.regexp_extract_all(line, F.lit(BLOCK_MARK), F.lit(0)), lambda m: F.struct((i + 1).cast("bigint").alias("line_no"), m.alias("mark")))
        return F.when(F.contains(line, F.lit("PRIVATE KEY")), marks)

    def key_chars(body: Column) -> Column:
        broken = F.regexp_replace(body, r"\\[nr]", "\n")
        bare = F.regexp_replace(broken, r"[A-Za-z][A-Za-z-]{0,40}: [^\r\n]*", "")
        return F.length(F.regexp_extract(F.regexp_replace(bare, f"[{tx.SPACE_SET}\"',]+", ""), "^[A-Za-z0-9+/=]*", 0))

    def blocks(marks: Column, pieces: Column) -> Column:
        def block(m: Column, k: Column) -> Column:
            after = F.get(marks, k + 1)
            closed = F.coalesce(after["mark"] == F.replace(m["mark"], F.lit("-BEGIN "), F.lit("-END ")), F.lit(False))
            return F.struct(
                m["line_no"].alias("line_no"),
                F.when(closed, after["line_no"]).alias("last_line_no"),
                F.regexp_extract(m["mark"], "-BEGIN ([A-Z0-9 ]+)-", 1).alias("label"),
                closed.alias("closed"),
                key_chars(F.get(pieces, k + 1)).cast("bigint").alias("n_chars"),
            )

        return F.transform(marks, block)

    value = F.col(text)
    marks = F.flatten(F.array_compact(F.transform(tx.text_lines(value), in_line)))
    found = tx.bind(marks, lambda ms: tx.bind(F.split(value, BLOCK_MARK), lambda ps: blocks(ms, ps)))
    rows = texts.filter(F.contains(value, F.lit("PRIVATE KEY"))).select(*keep, F.explode(found).alias("_block"))
    return rows.select(*keep, "_block.*").filter((F.col("label") != "") & (F.col("n_chars") >= LEAST_KEY))


RANDOM_VALUE = r"[:=]\s{0,8}[\"']([A-Za-z0-9+/=_-]{20,})[\"']"
HEX_BITS, MIXED_BITS = 3.0, 4.0


def scan_random_values(texts: DataFrame, keep: list[str], text: str) -> DataFrame:
    """Quoted values assigned to any name that look random: (keep..., line_no, nth, entropy, masked).

    Hex digits count from 32 characters and HEX_BITS bits a character on; other values need a capital, a small
    letter, a digit and MIXED_BITS, so that words, paths and names written with dashes are left out. `nth` is
    the place among the quoted long values of the line, from 1.
    """
    lines = to_lines(texts, keep, text).filter(F.contains("line", F.lit("=")) | F.contains("line", F.lit(":")))
    values = lines.select(*keep, "line_no", F.posexplode(F.regexp_extract_all("line", F.lit(RANDOM_VALUE), F.lit(1))).alias("_pos", "_value"))
    value, bits = F.col("_value"), F.col("entropy")
    rated = values.withColumn("entropy", F.round(tx.entropy(value), 6))
    is_hex = value.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$") & (bits >= HEX_BITS)
    is_mixed = value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9]") & (bits >= MIXED_BITS)
    return rated.filter(is_hex | is_mixed).select(
        *keep, "line_no", (F.col("_pos") + 1).cast("bigint").alias("nth"), F.round(bits, 3).alias("entropy"), _masked(value, 0).alias("masked")
    )


# --- manifests ------------------------------------------------------------------------------

_DEPENDENCIES = "array<struct<section string, name string, version string>>"


def _dependency(section: Column, name: Column, version: Column) -> Column:
    return F.struct(section.alias("section"), name.alias("name"), version.alias("version"))


def package_json_dependencies(content: Column) -> Column:
    """Array of (section, name, version); NULL when the text is no usable JSON object."""
    # As the only element of an array, so that text behind the object is noticed.
    schema = "array<struct<dependencies: map<string,string>, devDependencies: map<string,string>>>"
    parsed = F.from_json(F.concat(F.lit("["), content, F.lit("]")), schema)
    keys = F.try_element_at(F.from_json(F.concat(F.lit("["), content, F.lit("]")), "array<map<string,string>>"), F.lit(1))

    def usable(read: Column) -> Column:
        first = F.try_element_at(read["parsed"], F.lit(1))
        # a section that is there must be a map of texts
        unread = [
            F.coalesce(F.array_contains(F.map_keys(read["keys"]), n), F.lit(False)) & first[n].isNull() for n in ("dependencies", "devDependencies")
        ]
        return F.when((F.size(read["parsed"]) == 1) & read["keys"].isNotNull() & ~reduce(or_, unread), first)

    def section(root: Column, name: str) -> Column:
        entries = F.coalesce(F.map_entries(root[name]), F.array().cast("array<struct<key string, value string>>"))
        names = F.transform(entries, lambda e: e["key"])
        # A repeated key holds its last value; only then are entries compared with those behind them.
        last = F.filter(entries, lambda e, k: ~F.exists(F.slice(entries, k + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
        kept = F.when(F.size(F.array_distinct(names)) == F.size(entries), entries).otherwise(last)
        return F.transform(kept, lambda e: _dependency(F.lit(name), e["key"], e["value"]))

    return tx.bind(
        tx.bind(F.struct(parsed.alias("parsed"), keys.alias("keys")), usable),
        lambda root: F.when(
            root.isNotNull(),
            F.concat(section(root, "dependencies"), section(root, "devDependencies")),
        ),
    ).cast(_DEPENDENCIES)


def requirements_dependencies(content: Column) -> Column:
    """Array of (section, name, version) for lines of a name and at most one version clause."""
    spec = rf"^([A-Za-z0-9_.\-\[\]]+){S}*([=<>!~]{{1,2}}=?{S}*[{W[1:-1]}.*]*)?$"
    lines = F.transform(tx.text_lines(content), tx.strip)
    listed = F.filter(lines, lambda line: ~line.rlike("^(?:$|#|-)") & line.rlike(spec))
    return F.transform(
        listed,
        lambda line: _dependency(F.lit("requirements"), F.regexp_extract(line, spec, 1), F.regexp_extract(line, spec, 2)),
    ).cast(_DEPENDENCIES)


def csproj_dependencies(content: Column) -> Column:
    pattern = f'<PackageReference{S}+Include="([^"]+)"{S}+Version="([^"]+)"'
    return F.transform(
        tx.extract_pairs(content, pattern, "name", "version"),
        lambda d: _dependency(F.lit("PackageReference"), d["name"], d["version"]),
    ).cast(_DEPENDENCIES)


def _manifests(files: DataFrame) -> DataFrame:
    """Root-level manifests with `deps`, NULL where the manifest cannot be parsed."""
    path, content = F.col("path"), F.col("content")
    at_root = files.filter(~path.rlike(r"[/\\]"))
    known = at_root.filter(path.isin("package.json", "requirements.txt") | path.endswith(".csproj"))
    deps = (
        F.when(path == "package.json", package_json_dependencies(content))
        .when(path == "requirements.txt", requirements_dependencies(content))
        .otherwise(csproj_dependencies(content))
    )
    return known.select("repo", path.alias("manifest"), deps.alias("deps"))


def _dependency_rows(manifests: DataFrame) -> DataFrame:
    # An expression, not a column: over a column Spark infers a filter that parses every manifest again.
    listed = F.coalesce("deps", F.array().cast(_DEPENDENCIES))
    rows = manifests.select("repo", "manifest", F.posexplode(listed).alias("_pos", "_dep"))
    return rows.select("repo", "manifest", (F.col("_pos") + 1).cast("bigint").alias("pos"), "_dep.*")


def deps_package_json(files: DataFrame) -> DataFrame:
    return _dependency_rows(_manifests(files.filter(F.col("path") == "package.json")))


def deps_requirements(files: DataFrame) -> DataFrame:
    return _dependency_rows(_manifests(files.filter(F.col("path") == "requirements.txt")))


def deps_csproj(files: DataFrame) -> DataFrame:
    return _dependency_rows(_manifests(files.filter(F.col("path").endswith(".csproj"))))


def list_dependencies(files: DataFrame) -> DataFrame:
    """Dependencies of all root-level manifests: (repo, manifest, pos, section, name, version)."""
    return _dependency_rows(_manifests(files))


def dependency_counts(files: DataFrame) -> DataFrame:
    """(repo, manifest, packages, status); an unparsable manifest is a row, not a failure."""
    parsed = F.col("deps").isNotNull()
    return _manifests(files).select(
        "repo",
        "manifest",
        F.when(parsed, F.size("deps").cast("bigint")).alias("packages"),
        F.when(parsed, "ok").otherwise("could not parse").alias("status"),
    )


# --- diffs ----------------------------------------------------------------------------------


def diff_files(diffs: DataFrame) -> DataFrame:
    """Changed files from numstat text: (repo, path, added, deleted); binary files count 0."""
    lines = diffs.select("repo", F.explode(tx.text_lines(F.col("numstat"), "captured")).alias("_line"))
    fields = lines.select("repo", F.split("_line", "\t").alias("_f")).filter(F.size("_f") == 3)
    return fields.select(
        "repo", F.col("_f")[2].alias("path"), _numstat_count(0).alias("added"), _numstat_count(1).alias("deleted")
    )


def _numstat_count(field: int) -> Column:
    text = F.col("_f")[field]
    return F.coalesce(F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint")), F.lit(0))


def diff_totals(diffs: DataFrame) -> DataFrame:
    """(repo, files, added, deleted, status) for every repository that has a diff row."""
    lines = diffs.select("repo", F.explode_outer(tx.text_lines(F.col("numstat"), "captured")).alias("_line"))
    fields = lines.select("repo", "_line", F.split("_line", "\t").alias("_f"))
    changed = F.size("_f") == 3
    some = F.max(F.coalesce(~tx.is_blank(F.col("_line")), F.lit(False)))
    totals = fields.groupBy("repo").agg(
        F.count(F.when(changed, 1)).alias("files"),
        F.coalesce(F.sum(F.when(changed, _numstat_count(0))), F.lit(0)).alias("added"),
        F.coalesce(F.sum(F.when(changed, _numstat_count(1))), F.lit(0)).alias("deleted"),
        some.alias("_any"),
    )
    status = F.when(F.col("_any"), "changed").otherwise("no changes")
    return totals.select("repo", "files", "added", "deleted", status.alias("status"))


def diff_symbols(diffs: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct hunk contexts of each repository, sorted, the first `limit` if given: (repo, rank, symbol)."""
    d = tx.DIGIT
    hunk = f"(?md)^@@ -{d}+(?:,{d}+)? \\+{d}+(?:,{d}+)? @@{S}*(.*)$"
    found = diffs.select("repo", F.explode(F.regexp_extract_all("patch", F.lit(hunk), F.lit(1))).alias("_s"))
    symbols = found.select("repo", tx.strip(F.col("_s")).alias("symbol")).filter(F.col("symbol") != "").distinct()
    if limit is None:
        return ranked_within(symbols, ["repo"], ["symbol"]).select("repo", "rank", "symbol")
    order = Window.partitionBy("repo").orderBy("symbol")
    ranked = symbols.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return ranked.select("repo", F.col("rank").cast("bigint").alias("rank"), "symbol")


# --- status ---------------------------------------------------------------------------------


def recent_commits(commits: DataFrame, n: int = MAX_COMMITS) -> DataFrame:
    """The newest `n` commits per repository: (repo, rank, commit_id, subject)."""
    order = Window.partitionBy("repo").orderBy(F.desc("ts"), F.desc("commit_id"))
    ranked = commits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return ranked.select("repo", F.col("rank").cast("bigint").alias("rank"), "commit_id", "subject")


def status_report(
    files: DataFrame,
    commits: DataFrame,
    diffs: DataFrame,
    test_runs: DataFrame | None = None,
    builds: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """One record per repository: file count, newest commits, diff totals, test and build results.

    `test_runs` and `builds` (lines, runs) use the repository as run_id; absent parts are NULL.
    """
    line = F.concat(F.col("commit_id"), F.lit(" "), F.col("subject"))
    newest = recent_commits(commits).groupBy("repo").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]).alias(
            "commits"
        )
    )
    totals = diff_totals(diffs).withColumnsRenamed(
        {"files": "changed_files", "added": "lines_added", "deleted": "lines_deleted", "status": "diff_status"}
    )
    known = files.select("repo").union(commits.select("repo")).union(diffs.select("repo")).distinct()
    report = known.join(file_inventory(files), "repo", "left").fillna(0, ["file_count"]).join(newest, "repo", "left").join(totals, "repo", "left")
    if test_runs is not None:
        tests = test_digest(test_runs).select(
            F.col("run_id").alias("repo"), "passed", "failed", "skipped", F.col("status").alias("test_status")
        )
        report = report.join(tests, "repo", "left")
    if builds is not None:
        build = build_digest(*builds).select(
            F.col("run_id").alias("repo"), "error_lines", "warning_lines", F.col("status").alias("build_status")
        )
        report = report.join(build, "repo", "left")
    return report
