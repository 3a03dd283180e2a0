"""Artifacts rendered from the given relational tables, row by row.

The tables hold no logs, runs or source trees; each view writes such text out of a table's
columns, so operators work on text while the expected answer still follows from the columns.
No view groups rows to build one big text: every rendered value belongs to one table row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.operators.runs import run_lines


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table whose rows mean work on text, as scanned."""
    return table(spark, folder, name)


def tasks(spark: SparkSession) -> int:
    """Into how many tasks work is dealt whose input is a split or two."""
    return 2 * spark.sparkContext.defaultParallelism


def dealt(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of short rows, each of which becomes whole files: a few MB are one split, so the rows are dealt out first."""
    return table(spark, folder, name).repartition(tasks(spark))


def _t(*parts: Column | str) -> Column:
    """Text of literals (str) and columns, numbers in plain form."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _pick(index: Column, *options: str) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (index + 1).cast("int"))


# --- logs and runs --------------------------------------------------------------------------


def event_lines(events: DataFrame) -> DataFrame:
    """Events (a table or a stream of them) as log lines with their time."""
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    line = _t(stamp, " ", F.upper("event_type"), " user=", F.col("user_id"), " props=", F.col("props"))
    return events.select(F.lit("app").alias("source"), F.col("event_id").alias("line_no"), F.col("ts").cast("timestamp").alias("ts"), line.alias("line"))


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    return event_lines(texts(spark, folder, "events")).drop("ts")


LOG_FILE = 5000


def write_event_log(spark: SparkSession, folder: str, place: str) -> None:
    """The log as text files of 5,000 events in order, a folder `file=<number>` for each."""
    lines = event_lines(table(spark, folder, "events")).withColumn("file", F.floor(F.col("line_no") / LOG_FILE))
    ordered = lines.repartition("file").sortWithinPartitions("file", "line_no")
    ordered.select("file", "line").write.partitionBy("file").text(place)


DELIVERIES = 3


def event_deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """The events with `delivery`, 0 to 2: thirds by event_id, and of each a fiftieth one delivery late."""
    events = table(spark, folder, "events")
    n = (events.agg(F.max("event_id")).first()[0] or 0) + 1
    own = F.floor(F.col("event_id") * DELIVERIES / n)
    late = (F.col("event_id") % 50 == 7).cast("int")
    return events.withColumn("delivery", F.least(own + late, F.lit(DELIVERIES - 1)))


def folder_of(written: DataFrame) -> str:
    """The folder of a table that was written as one."""
    return written.inputFiles()[0].rsplit("/", 1)[0]


def build_lines(spark: SparkSession, folder: str, run: str) -> DataFrame:
    part = F.col("l_partkey")
    word = _pick(part % 5, "mismatch", "missing", "unused", "overflow", "cycle")
    letter = _pick(F.floor(part / 5) % 8, *"abcdefgh")
    code = F.when(part % 4 == 0, "IDE0005").otherwise(_t("TS", F.col("l_suppkey") % 7))
    line = (
        F.when(
            F.col("l_returnflag") == "R",
            _t("src/f", part, ".ts(", F.col("l_linenumber"), ",5): error ", code, ": ", word, " ", letter, "  "),
        )
        .when(F.col("l_returnflag") == "A", _t("warning: ", word, " in f", part))
        .otherwise(_t("compiled f", part))
    )
    place = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * (1 << 28) + part
    return texts(spark, folder, "lineitem").select(F.col(run).alias("run_id"), place.alias("line_no"), line.alias("line"))


def build_runs(spark: SparkSession, folder: str, run: str) -> DataFrame:
    """Runs with an error fail, and every tenth run fails without saying why."""
    error = F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
    runs = table(spark, folder, "lineitem").groupBy(F.col(run).alias("run_id")).agg(error.alias("_error"))
    return runs.select("run_id", F.greatest(F.col("_error"), F.when(F.col("run_id") % 10 == 0, 1).otherwise(0)).alias("exit_code"))


def test_runs(spark: SparkSession, folder: str) -> DataFrame:
    """One run per customer; order states F, O, P are passed, failed, skipped tests."""
    count = lambda state: F.count(F.when(F.col("o_orderstatus") == state, 1))
    counts = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("run_id")).agg(
        count("F").alias("ok"), count("O").alias("bad"), count("P").alias("skip")
    )
    ok, bad, skip = F.col("ok"), F.col("bad"), F.col("skip")
    total = ok + bad + skip
    half = lambda c: F.floor(c / 2)

    def assembly(name: str, passed: Column, failed: Column, skipped: Column) -> Column:
        word = F.when(failed > 0, "Failed").otherwise("Passed")
        return _t(
            word, "!  - Failed:     ", failed, ", Passed:    ", passed, ", Skipped:     ", skipped,
            ", Total:    ", passed + failed + skipped, f", Duration: 1 s - {name}.dll (net8.0)\n",
        )

    result = F.when(bad > 0, _t("FAILED (failures=", bad, ", skipped=", skip, ")")).otherwise(_t("OK (skipped=", skip, ")"))
    kind = F.col("run_id") % 7
    output = (
        F.when(kind == 0, _t("Test summary: total: ", total, ", failed: ", bad, ", succeeded: ", ok, ", skipped: ", skip, ", duration: 1.1s\n"))
        .when(kind == 1, _t("Test run summary: done\n  total: ", total, "\n  failed: ", bad, "\n  succeeded: ", ok, "\n  skipped: ", skip, "\n"))
        .when(kind == 2, F.concat(assembly("A", half(ok), half(bad), half(skip)), assembly("B", ok - half(ok), bad - half(bad), skip - half(skip))))
        .when(kind == 3, _t("Tests:       ", bad, " failed, ", skip, " skipped, ", ok, " passed, ", total, " total\n"))
        .when(kind == 4, _t("Ran ", total, " tests in 0.5s\n\n", result, "\n"))
        .when(kind == 5, _t("=== ", bad, " failed, ", ok, " passed, ", skip, " skipped, 3 warnings in 0.42s ===\n"))
        .otherwise(F.lit("all good\n"))
    )
    return counts.select("run_id", F.when(bad > 0, 1).otherwise(0).alias("exit_code"), output.alias("output"))


def test_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A line per open order (a failing test) and per shipped one, then the run's own output."""
    word = F.when(F.col("o_orderstatus") == "O", "FAILED").otherwise("PASSED")
    cases = texts(spark, folder, "orders").select(
        F.col("o_custkey").alias("run_id"),
        F.col("o_orderkey").alias("line_no"),
        _t("  t", F.col("o_orderkey"), ".py::", F.col("o_orderpriority"), " ", word).alias("line"),
    )
    tail = run_lines(test_runs(spark, folder)).withColumn("line_no", F.col("line_no") + (1 << 50))
    return cases.unionByName(tail)


# --- repositories ---------------------------------------------------------------------------


def source_files(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey")
    python = F.when(k % 9 == 0, _t("def broken", k, "(:\n")).otherwise(
        _t("import os\n\n\nasync def load_", k, "():\n    def inner():\n        pass\n\n\nclass C", k, ":\n    def run(self):\n        pass\n")
    )
    script = _t("export async function run", k, "() {}\n  class W", k, " {}\nconst f = () => 1;\nexport default function\n  last", k, "() {}\n")
    kind = k % 3
    return dealt(spark, folder, "part").select(
        F.col("p_brand").alias("repo"),
        _t(_pick(k % 10, "src", "lib", "src", "node_modules", "src", "lib", "src", "lib", "src", ".cache"), "/m", k, _pick(kind, ".py", ".ts", ".md")).alias("path"),
        F.when(kind == 0, python).when(kind == 1, script).otherwise(_t("# ", F.col("p_name"), "\n")).alias("content"),
    )


def write_source_tree(spark: SparkSession, folder: str, place: str) -> None:
    """The source files as files below `place`, a folder per repository; a tenth of them are `__init__` files of a package."""
    files = source_files(spark, folder).select(
        F.concat_ws("/", F.lit(""), "repo", F.regexp_replace("path", r"/m([0-9]*5)\.", "/p$1/__init__.")).alias("path"), F.encode("content", "utf-8").alias("content")
    )

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as arrow_fs

        store, top = arrow_fs.FileSystem.from_uri(place)
        known = set()
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                home = (top + path).rsplit("/", 1)[0]
                if home not in known:
                    store.create_dir(home, recursive=True)
                    known.add(home)
                with store.open_output_stream(top + path) as out:
                    out.write(content)
            yield batch[["path"]]

    files.mapInPandas(write, "path string").write.format("noop").mode("overwrite").save()


def marker_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files, with a marker in front of four lines out of seven."""
    def marked(line: Column, i: Column) -> Column:
        return F.concat(_pick((F.col("doc_id") + i + 1) % 7, "TODO: ", "FIXME: ", "HACK ", "XXX: ", "", "", ""), line)

    return texts(spark, folder, "documents").select(
        F.col("source").alias("repo"),
        _t("docs/", F.col("doc_id"), ".txt").alias("path"),
        F.array_join(F.transform(F.split("text", "\n"), marked), "\n").alias("content"),
    )


def key_files(spark: SparkSession, folder: str) -> DataFrame:
    """A file per part that holds a key block: closed, open, a placeholder, on one line, one after an open one, or a public one."""
    k = F.col("p_partkey")
    body = F.sha2(k.cast("string"), 256)
    forms = (
        _t("# key\n-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\n", body, "\n", body, "\n-----END RSA PRIVATE KEY-----\n"),
        _t("-----BEGIN PRIVATE KEY-----\n", body, "\n"),
        _t("-----BEGIN PRIVATE KEY-----\n<your key here>\n-----END PRIVATE KEY-----\n"),
        _t('{"key": "-----BEGIN EC PRIVATE KEY-----\\n', body, '\\n-----END EC PRIVATE KEY-----\\n"}'),
        _t("-----BEGIN PRIVATE KEY-----\r\n", body, "\r\n-----BEGIN DSA PRIVATE KEY-----\r\n", body, "\r\n-----END DSA PRIVATE KEY-----"),
        _t("-----BEGIN PUBLIC KEY-----\n", body, "\n-----END PUBLIC KEY-----\n"),
    )
    content = F.element_at(F.array(*forms), (k % len(forms) + 1).cast("int"))
    return dealt(spark, folder, "part").select(_t("repo-", k).alias("repo"), _t("keys/", k, ".pem").alias("path"), content.alias("content"))


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    k, size, name = F.col("p_partkey"), F.col("p_size"), F.regexp_replace("p_name", " ", "-")
    package = F.when(k % 11 == 0, F.lit('{"dependencies": ')).otherwise(
        _t('{"name": "r", "dependencies": {"', name, '": "^', size, '.0.0"}, "devDependencies": {"jest-', k, '": "29.0"}}')
    )
    requirements = _t("# pinned\n", name, "==", size, ".1\n-r base.txt\nflask>=2,<3\n\nplain-", k, "\n")
    csproj = _t('<Project>\n<PackageReference Include="Lib.', k, '" Version="', size, '.0.1" />\n<PackageReference Version="1" Include="Swapped" />\n</Project>\n')
    entry = lambda path, content: F.struct(path.alias("path"), content.alias("content"))
    rows = F.array(
        entry(F.lit("package.json"), package),
        entry(F.lit("requirements.txt"), requirements),
        entry(_t("App", k, ".csproj"), csproj),
        entry(F.lit("nested/package.json"), package),
        entry(F.lit("readme.md"), F.lit("text")),
    )
    return dealt(spark, folder, "part").select(_t("repo-", k).alias("repo"), F.explode(rows).alias("_f")).select("repo", "_f.*")


def diffs(spark: SparkSession, folder: str) -> DataFrame:
    """One row per line item; the order is the repository. Returned items are binary files."""
    path = _t("src/", F.col("l_partkey"), ".py")
    numstat = (
        F.when(F.col("l_linenumber") == 7, F.lit(""))
        .when(F.col("l_returnflag") == "A", _t("-\t-\t", path, "\n"))
        .otherwise(_t(F.col("l_quantity").cast("bigint"), "\t", F.col("l_linenumber"), "\t", path, "\n"))
    )
    patch = _t("--- a\n+++ b\n@@ -1,3 +1,4 @@ def f", F.col("l_suppkey"), "():\n keep\n-old\n+new\n@@ -10 +11 @@\n tail\n")
    return texts(spark, folder, "lineitem").select(F.col("l_orderkey").alias("repo"), numstat.alias("numstat"), patch.alias("patch"))


def commits(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("commit_id"), F.col("o_orderdate").alias("ts"),
        F.col("o_orderpriority").alias("subject"),
    )


def order_files(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(F.col("o_custkey").alias("repo"), _t(F.col("o_orderkey"), ".txt").alias("path"))


def order_diffs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("repo"),
        F.when(F.col("o_orderstatus") == "P", F.lit("")).otherwise(_t(F.col("o_orderkey") % 100, "\t3\t", F.col("o_orderkey"), ".txt")).alias("numstat"),
        F.lit("").alias("patch"),
    )


# --- project graph --------------------------------------------------------------------------


def _project(k: Column) -> Column:
    return _t("P", F.lpad(k.cast("string"), 10, "0"), ".", _pick(k % 4, "Utility", "DB", "Orders", "WebApi"))


def graph_files(spark: SparkSession, folder: str) -> DataFrame:
    """One project per supplier k, fifty to a repository: k to k+1 within blocks of five, k to k-4 at each second block's
    end, k to k+7 for every third k. Targets outside the repository are dangling."""
    k = F.col("s_suppkey")

    def reference(condition: Column, target: Column, style: str) -> Column:
        name = _project(target)
        return F.when(condition, _t(f'  <ProjectReference Include="..{style}', name, style, name, '.csproj" />\r\n')).otherwise("")

    body = F.concat(
        F.lit("<Project>\r\n"),
        reference(k % 5 < 4, k + 1, "\\"),
        reference(k % 10 == 4, k - 4, "/"),
        reference(k % 3 == 0, k + 7, "\\"),
        reference(k % 5 < 4, k + 1, "/"),
        F.lit("</Project>\r\n"),
    )
    name = _project(k)
    return table(spark, folder, "supplier").select(
        _t("repo-", F.floor(k / 50)).alias("repo"), _t("src/", name, "/", name, ".csproj").alias("path"), body.alias("content")
    )


def one_repository_edges(spark: SparkSession, folder: str) -> DataFrame:
    """All suppliers in one repository: a ring through every one, and a hub that references as many spokes, the even ones back."""
    suppliers = table(spark, folder, "supplier")
    low, high = suppliers.agg(F.min("s_suppkey"), F.max("s_suppkey")).first()
    k = F.col("s_suppkey")

    def named(kind: str, key: Column) -> Column:
        return _t(kind, F.lpad(key.cast("string"), 9, "0"))

    def edge(src: Column, dst: Column, pos: Column) -> Column:
        return F.struct(src.alias("src"), dst.alias("dst"), pos.cast("bigint").alias("pos"))

    onward = F.when(k == high, F.lit(low)).otherwise(k + 1)
    found = F.array(
        edge(named("Ring", k), named("Ring", onward), F.lit(0)),
        edge(F.lit("Hub"), named("Spoke", k), k),
        F.when(k % 2 == 0, edge(named("Spoke", k), F.lit("Hub"), F.lit(0))),
        F.when(k == low, edge(F.lit("Hub"), named("Ring", k), F.lit(high) + 1)),
    )
    rows = suppliers.select(F.explode(F.filter(found, lambda e: e.isNotNull())).alias("e"))
    return rows.select(F.lit("one").alias("repo"), "e.src", "e.dst", "e.pos")


# --- diagnostics and rewrites ---------------------------------------------------------------


PRUNE_RUNS = 6


def sarif_files(spark: SparkSession, folder: str) -> DataFrame:
    """One log per line item: run by order, project by supplier, framework by line status.

    Run 3 has broken logs, run 4 none by name, run 5 flags nothing.
    """
    run = F.col("l_orderkey") % PRUNE_RUNS
    k, project = F.col("l_partkey"), F.col("l_suppkey")
    tfm = F.when(F.col("l_linestatus") == "F", "net8.0").otherwise("net9.0")
    where = F.when(k % 13 == 0, "src/obj/f").otherwise("src/sub/../f")
    rule = F.when((F.col("l_quantity") == 1) | (run == 5), "CS0168").otherwise("IDE0005")
    suppressed = F.when(
        (F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 1), ', "suppressions": [{"kind": "inSource"}]'
    ).otherwise("")
    first = F.col("l_linenumber")
    body = _t(
        '{"version": "2.1.0", "runs": [{"results": [{"ruleId": "', rule, '"', suppressed,
        ', "locations": [{"physicalLocation": {"artifactLocation": {"uri": "', where, k,
        '.cs"}, "region": {"startLine": ', first, ', "endLine": ', first + k % 3, "}}}]}]}]}",
    )
    broken = (run == 3) & (F.col("l_quantity") == 50)
    name = _t("P_", project, "_", tfm, "_", project, F.when(run == 4, ".txt").otherwise(".sarif"))
    return texts(spark, folder, "lineitem").select(
        run.alias("run_id"), name.alias("file_name"), F.concat(body, F.when(broken, " oops").otherwise("")).alias("body")
    )


def prune_build_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Build outputs of the same runs; outside run 2 every error but those of the rule is a note."""
    lines = build_lines(spark, folder, "l_orderkey").withColumn("run_id", F.col("run_id") % PRUNE_RUNS)
    quiet = F.regexp_replace("line", "error (?!IDE)", "note ")
    return lines.withColumn("line", F.when(F.col("run_id") == 2, F.col("line")).otherwise(quiet))


def prune_build_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs 1 and 2 end with a bad exit code."""
    runs = table(spark, folder, "lineitem").select((F.col("l_orderkey") % PRUNE_RUNS).alias("run_id")).distinct()
    return runs.withColumn("exit_code", F.col("run_id").isin(1, 2).cast("int"))


def run_sources(spark: SparkSession, folder: str) -> DataFrame:
    """The same paths in every run, with other directives: twelve lines per part; odd parts open with a mark."""
    k, run = F.col("p_partkey"), F.col("run_id")
    line = lambda i: F.when((k + i + run) % 3 != 0, _t("using N", i, ".P", k, ";\r\n")).otherwise(_t("// note ", i, "\r\n"))
    content = F.concat(F.when(k % 2 == 1, "\ufeff").otherwise(""), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), line), ""))
    runs = F.sequence(F.lit(0).cast("bigint"), F.lit(PRUNE_RUNS - 1).cast("bigint"))
    copies = dealt(spark, folder, "part").select("p_partkey", F.explode(runs).alias("run_id"))
    return copies.select("run_id", _t("src/f", k, ".cs").alias("path"), F.encode(content, "UTF-8").alias("content"))


def csharp_files(spark: SparkSession, folder: str) -> DataFrame:
    """Twelve lines per part, two of three of them directives; odd parts open with a mark."""
    k = F.col("p_partkey")
    line = lambda i: F.when((k + i) % 3 != 0, _t("using N", i, ".P", k, ";\r\n")).otherwise(_t("// note ", i, "\r\n"))
    body = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), line), "")
    content = F.concat(F.when(k % 2 == 1, "\ufeff").otherwise(""), body)
    return dealt(spark, folder, "part").select(
        F.lit("main").alias("repo"), _t("src/f", k, ".cs").alias("path"), F.encode(content, "UTF-8").alias("content")
    )


NAMESPACES = {"Kiln.Clay": "Kiln.Glaze", "Kiln.Clay.Deep": "Kiln.Shards", "Kiln.Glaze": "Kiln.Enamel"}


def rename_files(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey")
    header = _t("// src/Old/f", k, ".cs\r\n")
    code = _t("using Kiln.Clay.P", k, ";\r\nnamespace Kiln.Clay.Deep.X;\r\n// café\r\n")
    text = (
        F.when(k % 5 == 0, F.concat(header, code))
        .when(k % 5 == 1, F.concat(F.lit("\ufeff"), header, code))
        .when(k % 5 == 2, _t("<RootNamespace>Kiln.Clay</RootNamespace>\n<AssemblyName>Kiln.Clay</AssemblyName>\n", k))
        .when(k % 5 == 3, _t('Include="..\\Kiln.Clay\\Kiln.Clay.csproj" Kiln.Claypit Shop.Kiln.Clay.X ', k))
        .otherwise(_t("using Kiln.Glaze; using Kiln.Clay; using Kiln.Clay.Deep;", k))
    )
    wide = k % 25 == 3
    content = F.when(wide, F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-8"))).otherwise(F.encode(text, "UTF-8"))
    return dealt(spark, folder, "part").select(
        F.lit("main").alias("repo"), _t("src/Old/f", k, _pick(k % 5, ".cs", ".cs", ".csproj", ".json", ".cs")).alias("path"), content.alias("content")
    )


def part_names(spark: SparkSession, folder: str) -> DataFrame:
    """A key for every part, and one that is a prefix of them all."""
    k = F.col("p_partkey")
    keys = table(spark, folder, "part").select(F.lit("main").alias("repo"), _t("Kiln.Clay.P", k).alias("old"), _t("Kiln.Glaze.Q", k).alias("new"))
    return keys.unionByName(spark.createDataFrame([("main", "Kiln.Clay", "Kiln.Mud")], "repo string, old string, new string"))


def rename_moves(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey")
    moved = table(spark, folder, "part").filter((k % 10 < 2) | (k % 50 == 3))
    name = _t("f", k, _pick(k % 5, ".cs", ".cs", ".csproj", ".json", ".cs"))
    return moved.select(F.lit("main").alias("repo"), _t("src/Old/", name).alias("src"), _t("src/New/Sub/", name).alias("dst"))


def _dealt(path: Column) -> Column:
    """The number of the repository, of twenty, that a renamed file is dealt to."""
    return F.regexp_extract(path, "f([0-9]+)", 1).cast("bigint") % 20


def dealt_files(spark: SparkSession, folder: str) -> DataFrame:
    return rename_files(spark, folder).withColumn("repo", _t("repo-", _dealt(F.col("path"))))


def dealt_moves(spark: SparkSession, folder: str) -> DataFrame:
    """Moves of the dealt files: of every four repositories one moves missing files, one moves files twice."""
    number = _dealt(F.col("src"))
    lost = F.when(number % 4 == 1, _t("gone/", F.col("src"))).otherwise(F.col("src"))
    targets = F.when(number % 4 == 2, F.array("dst", _t("more/", F.col("dst")))).otherwise(F.array("dst"))
    return rename_moves(spark, folder).select(_t("repo-", number).alias("repo"), lost.alias("src"), F.explode(targets).alias("dst"))


def move_map_texts(spark: SparkSession, folder: str) -> DataFrame:
    """A map file per region: renames and a move, only moves, or a broken one."""
    k = F.col("r_regionkey")
    move = _t('{"from": "src/./Old/f', k, '.cs", "to": "src\\\\New\\\\f', k, '.cs"}')
    names = _t('{"Kiln.Clay": "Region', k, '.Old", "Kiln.Clay.Deep": "Deep', k, '", "Kiln.Glaze": "Kiln.Clay"}')
    body = (
        F.when(k % 4 < 2, _t('{"moves": [', move, '], "namespaces": ', names, "}"))
        .when(k % 4 == 2, _t('{"moves": [', move, "]}"))
        .otherwise(_t('{"moves": [{"from": "only"}]}'))
    )
    return table(spark, folder, "region").select(_t("region-", k).alias("repo"), body.alias("body"))


def regional_rename_files(spark: SparkSession, folder: str) -> DataFrame:
    """`rename_files` dealt out to the regions' repositories, and to one without a map."""
    number = F.regexp_extract("path", "f([0-9]+)", 1).cast("bigint")
    return rename_files(spark, folder).withColumn("repo", _t("region-", number % 6))


def part_map_texts(spark: SparkSession, folder: str) -> DataFrame:
    """A map file per part, in the part's own repository: renames and a move, only a move, or a broken one."""
    k = F.col("p_partkey")
    name = _t("f", k, _pick(k % 5, ".cs", ".cs", ".csproj", ".json", ".cs"))
    move = _t('{"from": "src/./Old/', name, '", "to": "src\\\\New\\\\', name, '"}')
    names = _t('{"Kiln.Clay": "Part', k, '.Old", "Kiln.Clay.Deep": "Deep', k, '", "Kiln.Glaze": "Kiln.Clay"}')
    body = (
        F.when(k % 4 < 2, _t('{"moves": [', move, '], "namespaces": ', names, "}"))
        .when(k % 4 == 2, _t('{"moves": [', move, "]}"))
        .otherwise(_t('{"moves": [{"from": "only"}]}'))
    )
    return table(spark, folder, "part").select(_t("part-", k).alias("repo"), body.alias("body"))


def part_rename_files(spark: SparkSession, folder: str) -> DataFrame:
    """`rename_files`, each in the repository of its part."""
    number = F.regexp_extract("path", "f([0-9]+)", 1)
    return rename_files(spark, folder).withColumn("repo", _t("part-", number))


def faulty_moves(spark: SparkSession, folder: str) -> DataFrame:
    """Moves by part: missing sources, taken targets, shared targets, chains."""
    k = F.col("p_partkey")
    file = lambda n: _t("src/f", n, ".cs")
    return table(spark, folder, "part").select(
        F.lit("main").alias("repo"),
        F.when(k % 7 == 1, _t("src/gone", k, ".cs")).otherwise(file(k)).alias("src"),
        F.when(k % 7 == 2, file(k - k % 14))
        .when(k % 7 == 3, _t("new/shared", F.floor(k / 14), ".cs"))
        .otherwise(_t("new/f", k, ".cs"))
        .alias("dst"),
    )


# --- catalogs -------------------------------------------------------------------------------


def ddl_scripts(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("s_suppkey")
    text = _t(
        "-- supplier ", k, "\ncreate table if not exists t_", k, " (\n  id INTEGER,\n  `name` VARCHAR(20), extra TEXT,\n",
        "  n_", F.col("s_nationkey"), " INT,\n  PRIMARY KEY (id)\n);\nINSERT INTO x VALUES (1);\n",
        "CREATE TABLE [u_", k, "] (id INT, b INT);\n",
    )
    return table(spark, folder, "supplier").select(_t("s", k, ".sql").alias("script"), text.alias("text"))


def catalog_tables(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, folder, "part").select(
        _t("T", k).alias("table_name"), F.col("p_size").cast("bigint").alias("num_rows"), F.col("p_type").alias("last_analyzed")
    )


def catalog_segments(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "TABLE").when(F.col("l_returnflag") == "A", "INDEX").otherwise("TABLE PARTITION")
    prefix = F.when(F.col("l_partkey") % 5 != 0, "T").otherwise("INDEX_")  # a fifth of the segments belong to no table
    return table(spark, folder, "lineitem").select(
        F.concat(prefix, F.col("l_partkey").cast("string")).alias("segment_name"), kind.alias("segment_type"), F.col("l_quantity").cast("bigint").alias("bytes")
    )


def catalog_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Line items of an order, numbered by line number and part, as columns of its table."""
    return table(spark, folder, "lineitem").select(
        _t("T", F.col("l_orderkey")).alias("table_name"),
        (F.col("l_linenumber").cast("bigint") * 1000000000 + F.col("l_partkey")).alias("column_id"),
        _t("C", F.col("l_partkey")).alias("column_name"),
        F.when(F.col("l_returnflag") == "R", "NUMBER").otherwise("VARCHAR2").alias("data_type"),
        F.when(F.col("l_linestatus") == "O", "Y").otherwise("N").alias("nullable"),
    )


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        key.alias("sid"), (key % 97).alias("serial"), _t("U", F.col("o_custkey")).alias("username"), _t("os", key % 11).alias("osuser"),
        F.col("o_orderpriority").alias("program"), F.when(F.col("o_orderstatus") == "O", "ACTIVE").otherwise("INACTIVE").alias("status"),
        F.lit("User I/O").alias("wait_class"), _t("e", key % 5).alias("event"), key.alias("audsid"),
        F.when(key % 3 != 0, F.col("o_custkey")).alias("sql_id"), F.floor("o_totalprice").cast("bigint").alias("last_call_et"),
    )


def sql_area(spark: SparkSession, folder: str) -> DataFrame:
    k, balance = F.col("c_custkey"), F.floor(F.col("c_acctbal")).cast("bigint")
    return table(spark, folder, "customer").select(
        k.alias("sql_id"), _t("select ", F.col("c_name")).alias("sql_text"), (k % 13).alias("executions"),
        (balance * 3 + k).alias("buffer_gets"), ((k * 7919) % 100003).alias("disk_reads"),
        (balance * 1000 + k).alias("cpu_time"), (balance * 500000 + k).alias("elapsed_time"),
    )


def data_files(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        _t("TS", F.col("c_nationkey")).alias("tablespace_name"), ((F.col("c_custkey") % 100 + 1) * 1048576).cast("bigint").alias("bytes")
    )


def free_space(spark: SparkSession, folder: str) -> DataFrame:
    prefix = F.when(F.col("s_nationkey") % 4 != 0, "TS").otherwise("TEMP")  # of spaces without data files
    return table(spark, folder, "supplier").select(
        F.concat(prefix, F.col("s_nationkey").cast("string")).alias("tablespace_name"), ((F.col("s_suppkey") % 10) * 524288).cast("bigint").alias("bytes")
    )


def catalog_objects(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        _pick(k % 4, "SYS", "SYSTEM", "APP", "HR").alias("owner"), _pick(k % 3, "VIEW", "PROCEDURE", "FUNCTION").alias("object_type"),
        _t("O", k).alias("object_name"), F.when(F.col("o_orderstatus") == "P", "INVALID").otherwise("VALID").alias("status"),
    )


# --- settings and chat ----------------------------------------------------------------------


def env_texts(spark: SparkSession, folder: str) -> DataFrame:
    """A settings file per customer, and a real environment for every second one."""
    k = F.col("c_custkey")
    descriptor = _t("(DESCRIPTION=(ADDRESS=(PROTOCOL=TCP)(HOST = h", k, ")(PORT=1521))(CONNECT_DATA=(SERVICE_NAME=s", k, ")))")
    setup = (
        F.when(k % 8 == 0, _t("ORACLE_CONNECTION_STRING=Data Source=", descriptor, ";User  Id=u", k, ";Password=p=", k, ";\nORACLE_HOST=later\n"))
        .when(k % 8 == 1, _t("ORACLE_CONNECTION_STRING=data source=h:1/s;Password=x\n"))
        .when(k % 8 == 2, _t("ORACLE_HOST='h", k, ":1521/svc'\nORACLE_USERNAME=u", k, "\nORACLE_PASSWORD=\"secret\"\n"))
        .when(k % 8 == 3, _t("ORACLE_HOST=h", k, "\nORACLE_USERNAME=u\n"))
        .when(k % 8 == 4, _t("ORACLE_USER_SECRETS_ID=store", k % 3, "\nORACLE_SECRET_NAME=db\n"))
        .when(k % 8 == 5, _t("ORACLE_USER_SECRETS_ID=store", k, "\n"))
        .when(k % 8 == 6, _t("ORACLE_USER_SECRETS_ID=store0\nORACLE_SECRET_NAME=other\n"))
        .otherwise(F.lit(""))
    )
    file_text = F.concat(
        _t("# settings of ", F.col("c_name"), "\n\n  MODE = first\nno pair\n=nokey\nMODE=\"'", F.col("c_mktsegment"), "'\"\nEMPTY=\n"), setup
    )
    real = _t("REGION=n", F.col("c_nationkey"), "\n", F.when(k % 6 == 0, "MODE=real\n").otherwise(""))
    entry = lambda layer, text: F.struct(F.lit(layer).alias("layer"), text.alias("text"))
    layers = F.when(k % 2 == 0, F.array(entry("file", file_text), entry("real", real))).otherwise(F.array(entry("file", file_text)))
    return texts(spark, folder, "customer").select(k.alias("repo"), F.explode(layers).alias("_l")).select("repo", "_l.*")


def templates(spark: SparkSession, folder: str) -> DataFrame:
    text = F.when(F.col("c_custkey") % 2 == 0, F.lit("mode: ${MODE}\nregion: ${REGION:none}\nwallet: ${EMPTY:}\n")).otherwise(
        F.lit("mode: ${MODE:x}\nregion: ${REGION}\nkind: ${MODE}\n")
    )
    return texts(spark, folder, "customer").select(F.col("c_custkey").alias("repo"), F.lit("t").alias("template"), text.alias("text"))


def secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Stores by region: store0 and store1 have a usable entry, others none of that name."""
    k = F.col("r_regionkey")
    return table(spark, folder, "region").select(
        _t("store", k).alias("store_id"), F.when(k < 2, "db").otherwise("misc").alias("name"),
        F.when(k == 0, "Data Source=alias0;User Id=su;Password=sp").otherwise("Data Source=(HOST=x);User Id=su;Password=sp").alias("value"),
    )


def connection_strings(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey")
    source = (
        F.when(k % 4 == 0, _t("(DESCRIPTION=(ADDRESS=(HOST=h", k, ")(PORT=15", k % 10, "))(CONNECT_DATA=(service_name=svc)))"))
        .when(k % 4 == 1, _t("(DESCRIPTION=(ADDRESS=(HOST=h", k, "))(CONNECT_DATA=(SERVICE_NAME=svc)))"))
        .when(k % 4 == 2, F.lit("(DESCRIPTION=(ADDRESS=(HOST=h)))"))
        .otherwise(_t(" plain", k, ":1/s "))
    )
    user = F.when(k % 5 == 0, "").otherwise(_t("user   ID=u", k, ";"))
    return texts(spark, folder, "customer").select(k.alias("repo"), _t("Data Source=", source, ";", user, "PASSWORD= p ;junk").alias("connection_string"))


def config_versions(orders: DataFrame) -> DataFrame:
    """Orders (a table or a stream of them) as settings versions of their customers."""
    k = F.col("o_orderkey")
    text = (
        F.when(F.col("o_orderstatus") == "F", _t("ORACLE_HOST=h", k, "\nORACLE_USERNAME=u\nORACLE_PASSWORD=p\n"))
        .when(F.col("o_orderstatus") == "O", _t("ORACLE_HOST=h", k, "\nORACLE_USERNAME=u\n"))
        .otherwise(F.lit("# nothing set\n"))
    )
    return orders.select(F.col("o_custkey").alias("repo"), k.alias("version"), text.alias("text"))


def user_texts(spark: SparkSession, folder: str) -> DataFrame:
    turns = texts(spark, folder, "conversations").filter(F.col("role") == "user")
    return turns.select(_t(F.col("conv_id"), "-", F.col("turn")).alias("id"), "text")


def chat_replies(spark: SparkSession, folder: str) -> DataFrame:
    """Assistant turns as answers: good, of another shape, and five kinds of failure."""
    kind = (F.col("conv_id") + F.col("turn")) % 8
    answer = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices")))
    status = (
        F.when(kind == 3, 401).when(kind == 4, 403).when(kind == 5, 500).when(kind == 6, F.lit(None)).otherwise(200).cast("int")
    )
    body = F.when(kind < 2, answer).when(kind == 2, F.concat(F.lit("no json: "), F.col("text"))).when(kind == 7, F.lit('{"choices": []}')).otherwise("")
    turns = texts(spark, folder, "conversations").filter(F.col("role") == "assistant")
    return turns.select(_t(F.col("conv_id"), "-", F.col("turn")).alias("id"), status.alias("http_status"), body.alias("body"))
