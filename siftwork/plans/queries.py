"""The registered queries: each runs one operator over whole tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions import text as tx
from siftwork.functions.paths import SOURCE_TREE_EXCLUDES
from siftwork.operators import catalog, chat, config, diagnostics, graph, lines, repo, rewrite, runs
from siftwork.plans import views as v
from siftwork.sources.checkpoints import materialize, new_location
from siftwork.sources.files import read_numbered_lines, register_tables, run_sql, walk_files
from siftwork.streaming.config_stream import keep_last_good, last_good_config, newest_config
from siftwork.streaming.log_stream import late_lines, top_window_patterns, write_window_patterns

LAYERS = "Utility; DB,FS; *; WebApi"
Query = Callable[[SparkSession, str], DataFrame]


def _joined(df: DataFrame, separator: str, *names: str) -> DataFrame:
    for name in names:
        df = df.withColumn(name, F.array_join(name, separator))
    return df


# --- logs -----------------------------------------------------------------------------------


def log_top_patterns(spark: SparkSession, folder: str) -> DataFrame:
    return lines.log_top_patterns(v.log_lines(spark, folder))


def doc_top_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of texts, of which most occur once, as the logs of their languages."""
    split = lines.to_lines(v.texts(spark, folder, "documents"), ["lang", "doc_id"], "text", "newline")
    placed = split.select(F.col("lang").alias("source"), (F.col("doc_id") * (1 << 24) + F.col("line_no")).alias("line_no"), "line")
    return lines.log_top_patterns_by_buckets(placed, 50)


def log_summary(spark: SparkSession, folder: str) -> DataFrame:
    return lines.log_summary(v.log_lines(spark, folder))


def log_window_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """The events as a stream in three deliveries, some of each only with the next; every delivery restarts the query."""
    arriving = v.event_deliveries(spark, folder)
    place, sink, state = (new_location(spark, name) for name in ("log-deliveries", "log-windows", "log-state"))
    for k in range(v.DELIVERIES):
        arriving.filter(F.col("delivery") == k).drop("delivery").write.mode("append").parquet(place)
        stream = spark.readStream.schema(arriving.drop("delivery").schema).parquet(place)
        write_window_patterns(v.event_lines(stream), sink, state).awaitTermination()
    closed = spark.read.parquet(sink)
    late = late_lines(v.event_lines(spark.read.parquet(place)), closed)
    top = top_window_patterns(closed, 3).join(late, ["source", "window_start"])
    return top.select(
        "source", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "rank", "n", "pattern", "first_no", "line", "lines", "late"
    )


def numbered_log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The log read back from text files of several splits each."""
    place, key = new_location(spark, "log-files"), "spark.sql.files.maxPartitionBytes"
    v.write_event_log(spark, folder, place)
    before = spark.conf.get(key)
    spark.conf.set(key, "128k")
    try:
        numbered = materialize(read_numbered_lines(spark, place), "numbered-lines")
    finally:
        spark.conf.set(key, before)
    return numbered.select(F.regexp_extract("source", "file=([0-9]+)", 1).cast("bigint").alias("file"), "line_no", "line")


def doc_line_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    split = lines.to_lines(v.texts(spark, folder, "documents"), ["lang", "doc_id"], "text", "newline")
    placed = split.withColumn("line_no", F.col("doc_id") * (1 << 24) + F.col("line_no"))
    return lines.dedupe_lines(placed.filter(~tx.is_blank(F.col("line"))), ["lang"])


def cap_text(spark: SparkSession, folder: str) -> DataFrame:
    return v.texts(spark, folder, "documents").select("doc_id", tx.cap_text(F.col("text"), 2000).alias("capped"))


def html_to_text(spark: SparkSession, folder: str) -> DataFrame:
    return v.texts(spark, folder, "pages").select("page_id", tx.html_to_text(F.col("html")).alias("text"))


# --- runs -----------------------------------------------------------------------------------


def classify_build_lines(spark: SparkSession, folder: str) -> DataFrame:
    classified = runs.classify_build_lines(v.build_lines(spark, folder, "l_suppkey"))
    return classified.groupBy("run_id", "class").agg(F.count("*").alias("n"))


def build_top_patterns(spark: SparkSession, folder: str) -> DataFrame:
    return runs.build_top_patterns(v.build_lines(spark, folder, "l_suppkey"))


def build_digest(spark: SparkSession, folder: str) -> DataFrame:
    digest = runs.build_digest(v.build_lines(spark, folder, "l_orderkey"), v.build_runs(spark, folder, "l_orderkey"))
    return digest.withColumn("last_lines", F.array_join("last_lines", "\n"))


def build_failed(spark: SparkSession, folder: str) -> DataFrame:
    return runs.build_failed(v.build_lines(spark, folder, "l_orderkey"), v.build_runs(spark, folder, "l_orderkey"))


def test_totals(spark: SparkSession, folder: str) -> DataFrame:
    return runs.test_totals(v.test_runs(spark, folder))


def test_failure_lines(spark: SparkSession, folder: str) -> DataFrame:
    return runs.test_failure_lines(v.test_lines(spark, folder))


def test_summary_lines(spark: SparkSession, folder: str) -> DataFrame:
    return runs.test_summary_lines(v.test_lines(spark, folder)).select("run_id", "line")


def test_digest(spark: SparkSession, folder: str) -> DataFrame:
    digest = runs.test_digest(v.test_runs(spark, folder), v.test_lines(spark, folder))
    return digest.select(
        "run_id", "exit_code", "passed", "failed", "skipped", "total", "failure_lines", "failure_patterns", "status"
    )


# --- repositories ---------------------------------------------------------------------------


def file_inventory(spark: SparkSession, folder: str) -> DataFrame:
    return repo.file_inventory(repo.tracked_files(v.source_files(spark, folder)))


def file_paths(spark: SparkSession, folder: str) -> DataFrame:
    return repo.file_paths(repo.tracked_files(v.source_files(spark, folder)))


def walked_files(spark: SparkSession, folder: str) -> DataFrame:
    """The source files read back from a folder tree: those of two extensions, without excluded and hidden folders."""
    place = new_location(spark, "source-tree")
    v.write_source_tree(spark, folder, place)
    files = walk_files(spark, place, SOURCE_TREE_EXCLUDES, [".py", ".ts"], skip_hidden=True, repo_depth=1)
    return files.select("repo", "path", F.octet_length("content").cast("bigint").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def python_symbols(spark: SparkSession, folder: str) -> DataFrame:
    return repo.python_symbols(v.source_files(spark, folder))


def js_symbols(spark: SparkSession, folder: str) -> DataFrame:
    return repo.js_symbols(v.source_files(spark, folder))


def repo_map(spark: SparkSession, folder: str) -> DataFrame:
    return _joined(repo.repo_map(repo.tracked_files(v.source_files(spark, folder))), ", ", "symbols")


def todo_markers(spark: SparkSession, folder: str) -> DataFrame:
    return repo.todo_markers(v.marker_files(spark, folder))


def todo_summary(spark: SparkSession, folder: str) -> DataFrame:
    # Written once, since the summary counts the markers and lists them: the texts are scanned once.
    markers = materialize(repo.todo_markers(v.marker_files(spark, folder)), "markers")
    return repo.todo_summary(markers)


def scan_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return repo.scan_secrets(v.texts(spark, folder, "documents"), ["doc_id"], "text")


def scan_secret_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return repo.scan_secret_blocks(v.key_files(spark, folder), ["repo", "path"], "content")


def scan_random_values(spark: SparkSession, folder: str) -> DataFrame:
    return repo.scan_random_values(v.texts(spark, folder, "documents"), ["doc_id"], "text")


def deps_package_json(spark: SparkSession, folder: str) -> DataFrame:
    return repo.deps_package_json(v.manifests(spark, folder))


def deps_requirements(spark: SparkSession, folder: str) -> DataFrame:
    return repo.deps_requirements(v.manifests(spark, folder))


def deps_csproj(spark: SparkSession, folder: str) -> DataFrame:
    return repo.deps_csproj(v.manifests(spark, folder))


def list_dependencies(spark: SparkSession, folder: str) -> DataFrame:
    return repo.list_dependencies(v.manifests(spark, folder))


def dependency_counts(spark: SparkSession, folder: str) -> DataFrame:
    return repo.dependency_counts(v.manifests(spark, folder))


def diff_files(spark: SparkSession, folder: str) -> DataFrame:
    return repo.diff_files(v.diffs(spark, folder))


def diff_totals(spark: SparkSession, folder: str) -> DataFrame:
    return repo.diff_totals(v.diffs(spark, folder))


def diff_symbols(spark: SparkSession, folder: str) -> DataFrame:
    return repo.diff_symbols(v.diffs(spark, folder))


def recent_commits(spark: SparkSession, folder: str) -> DataFrame:
    return repo.recent_commits(v.commits(spark, folder))


def status_report(spark: SparkSession, folder: str) -> DataFrame:
    report = repo.status_report(
        v.order_files(spark, folder),
        v.commits(spark, folder),
        v.order_diffs(spark, folder),
        v.test_runs(spark, folder),
        (v.build_lines(spark, folder, "l_suppkey"), v.build_runs(spark, folder, "l_suppkey")),
    )
    return _joined(report, "\n", "commits")


# --- graph ----------------------------------------------------------------------------------


def project_names(spark: SparkSession, folder: str) -> DataFrame:
    return graph.project_names(v.graph_files(spark, folder))


def project_edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.project_edges(v.graph_files(spark, folder))


def dangling_references(spark: SparkSession, folder: str) -> DataFrame:
    return graph.dangling_references(v.graph_files(spark, folder))


def adjacency(spark: SparkSession, folder: str) -> DataFrame:
    files = v.graph_files(spark, folder)
    return graph.adjacency(graph.project_names(files), graph.project_edges(files))


def strong_components(spark: SparkSession, folder: str) -> DataFrame:
    return graph.strong_components(graph.project_edges(v.graph_files(spark, folder)))


def find_cycles(spark: SparkSession, folder: str) -> DataFrame:
    return _joined(graph.find_cycles(graph.project_edges(v.graph_files(spark, folder))), " -> ", "cycle")


def one_repository_components(spark: SparkSession, folder: str) -> DataFrame:
    return graph.strong_components(v.one_repository_edges(spark, folder))


def one_repository_cycles(spark: SparkSession, folder: str) -> DataFrame:
    """As rows, since one cycle holds every supplier."""
    return graph.cycle_nodes(v.one_repository_edges(spark, folder))


def layer_of(spark: SparkSession, folder: str) -> DataFrame:
    names = graph.project_names(v.graph_files(spark, folder))
    spec = "u?ility*,util*; DB,FS; *.web[!x]*"
    return names.select("repo", "name", graph.layer_of(F.col("name"), spec).cast("bigint").alias("layer"))


def layer_violations(spark: SparkSession, folder: str) -> DataFrame:
    found = graph.layer_violations(graph.project_edges(v.graph_files(spark, folder)), LAYERS)
    return found.withColumns({c: F.col(c).cast("bigint") for c in ("src_level", "dst_level")})


def unassigned_projects(spark: SparkSession, folder: str) -> DataFrame:
    return graph.unassigned_projects(graph.project_names(v.graph_files(spark, folder)), "Utility; DB,FS; WebApi")


# --- diagnostics ----------------------------------------------------------------------------


def sarif_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    return diagnostics.sarif_diagnostics(v.sarif_files(spark, folder))


def sarif_contexts(spark: SparkSession, folder: str) -> DataFrame:
    return diagnostics.sarif_contexts(v.sarif_files(spark, folder))


def _removable(spark: SparkSession, folder: str) -> DataFrame:
    sarif = v.sarif_files(spark, folder)
    return diagnostics.select_removable(diagnostics.sarif_diagnostics(sarif), diagnostics.sarif_contexts(sarif))


def select_removable(spark: SparkSession, folder: str) -> DataFrame:
    return _removable(spark, folder)


def keep_directive_lines(spark: SparkSession, folder: str) -> DataFrame:
    return diagnostics.keep_directive_lines(_removable(spark, folder), v.run_sources(spark, folder))


def remove_lines(spark: SparkSession, folder: str) -> DataFrame:
    flagged = _removable(spark, folder).filter("status = 'removable'")
    edited = diagnostics.remove_lines(v.run_sources(spark, folder), flagged)
    return _joined(edited.withColumn("content", F.decode("content", "UTF-8")), ",", "removed", "skipped")


def unreadable_logs(spark: SparkSession, folder: str) -> DataFrame:
    return diagnostics.unreadable_logs(v.sarif_files(spark, folder))


def prune_report(spark: SparkSession, folder: str) -> DataFrame:
    return diagnostics.prune_report(
        v.sarif_files(spark, folder), v.run_sources(spark, folder), v.prune_build_lines(spark, folder), v.prune_build_runs(spark, folder)
    )


def prune_status(spark: SparkSession, folder: str) -> DataFrame:
    return diagnostics.prune_status(
        prune_report(spark, folder), v.sarif_files(spark, folder), v.prune_build_lines(spark, folder), v.prune_build_runs(spark, folder)
    )


# --- rewrites -------------------------------------------------------------------------------


def validate_moves(spark: SparkSession, folder: str) -> DataFrame:
    return rewrite.validate_moves(v.faulty_moves(spark, folder), v.csharp_files(spark, folder), {"Kiln.Clay": "Kiln.Glaze"})


def rename_namespaces(spark: SparkSession, folder: str) -> DataFrame:
    text = rewrite.rename_namespaces(F.decode("content", "ISO-8859-1"), v.NAMESPACES)
    renamed = v.rename_files(spark, folder).select("path", text.alias("_r"))
    return renamed.select(
        "path", F.hex(F.encode("_r.text", "ISO-8859-1")).alias("content_hex"), F.col("_r.replacements").alias("replacements")
    )


def rename_by_table(spark: SparkSession, folder: str) -> DataFrame:
    files = v.rename_files(spark, folder).withColumn("text", F.decode("content", "ISO-8859-1"))
    renamed = rewrite.rename_by_table(files, v.part_names(spark, folder))
    return renamed.select(
        "path", F.hex(F.encode("renamed.text", "ISO-8859-1")).alias("content_hex"), F.col("renamed.replacements").alias("replacements")
    )


def update_header(spark: SparkSession, folder: str) -> DataFrame:
    """Every file of rename_files; one that does not move keeps its text."""
    moves = v.rename_moves(spark, folder).withColumnRenamed("src", "path")
    files = v.rename_files(spark, folder).join(moves, ["repo", "path"], "left")
    text = F.decode("content", "ISO-8859-1")
    kept = F.struct(text.alias("text"), F.lit(False).alias("changed"))
    head = F.when(F.col("dst").isNull(), kept).otherwise(rewrite.update_header(text, F.col("path"), F.col("dst")))
    headed = files.select("path", head.alias("_h"))
    return headed.select("path", F.hex(F.encode("_h.text", "ISO-8859-1")).alias("content_hex"), F.col("_h.changed").alias("changed"))


def _plan(spark: SparkSession, folder: str) -> DataFrame:
    return rewrite.rewrite_plan(v.rename_files(spark, folder), v.rename_moves(spark, folder), v.NAMESPACES)


def rewrite_plan(spark: SparkSession, folder: str) -> DataFrame:
    return _plan(spark, folder).withColumn("content", F.hex("content"))


def gated_rewrite_plan(spark: SparkSession, folder: str) -> DataFrame:
    files, moves = v.dealt_files(spark, folder), v.dealt_moves(spark, folder)
    errors = rewrite.validate_moves(moves, files, v.NAMESPACES)
    plan = rewrite.rewrite_plan(rewrite.applicable(files, errors), rewrite.applicable(moves, errors), v.NAMESPACES)
    return plan.withColumn("content", F.hex("content"))


def rewrite_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rewrite.rewrite_summary(_plan(spark, folder))


def replaced_files(spark: SparkSession, folder: str) -> DataFrame:
    return rewrite.replaced_files(_plan(spark, folder))


def _map_sizes(texts: DataFrame) -> DataFrame:
    return rewrite.read_move_maps(texts).select(
        "repo", F.size("moves").cast("bigint").alias("moves"), F.size("namespaces").cast("bigint").alias("namespaces"), "status"
    )


def read_move_maps(spark: SparkSession, folder: str) -> DataFrame:
    return _map_sizes(v.part_map_texts(spark, folder))


def map_moves(spark: SparkSession, folder: str) -> DataFrame:
    return rewrite.map_moves(rewrite.read_move_maps(v.part_map_texts(spark, folder)))


def rewrite_plan_by_map(spark: SparkSession, folder: str) -> DataFrame:
    maps = rewrite.read_move_maps(v.part_map_texts(spark, folder))
    plan = rewrite.rewrite_plan(v.part_rename_files(spark, folder), rewrite.map_moves(maps), maps)
    return plan.withColumn("content", F.hex("content"))


# --- catalogs -------------------------------------------------------------------------------


def ddl_tables(spark: SparkSession, folder: str) -> DataFrame:
    return _joined(catalog.ddl_tables(v.ddl_scripts(spark, folder)), ", ", "columns")


def list_tables(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.list_tables(v.catalog_tables(spark, folder), v.catalog_segments(spark, folder))


def list_named_tables(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.list_tables(v.catalog_tables(spark, folder), v.catalog_segments(spark, folder), "T1,T5,T17,NOPE")


def table_names(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.table_names(v.catalog_tables(spark, folder))


def describe_table(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.describe_table(v.catalog_columns(spark, folder), "T7")


def describe_tables(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.describe_tables(v.catalog_columns(spark, folder))


def active_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.active_sessions(v.sessions(spark, folder), v.sql_area(spark, folder), own_audsid=7)


def top_sql_by_cpu(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.top_sql_by(v.sql_area(spark, folder), "CPU_TIME", 10)


def top_sql_by_default(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.top_sql_by(v.sql_area(spark, folder))


def tablespace_usage(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.tablespace_usage(v.data_files(spark, folder), v.free_space(spark, folder))


def invalid_objects(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.invalid_objects(v.catalog_objects(spark, folder))


def snapshot_sql(spark: SparkSession, folder: str) -> DataFrame:
    register_tables(spark, folder, ["orders", "customer"])
    return run_sql(
        spark,
        "SELECT c_mktsegment AS segment, count(*) AS n_orders, count(DISTINCT o_custkey) AS n_customers "
        "FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    )


# --- settings -------------------------------------------------------------------------------


def env_entries(spark: SparkSession, folder: str) -> DataFrame:
    return config.env_entries(v.env_texts(spark, folder))


def effective_config(spark: SparkSession, folder: str) -> DataFrame:
    return config.effective_config(config.env_entries(v.env_texts(spark, folder)))


def resolve_placeholders(spark: SparkSession, folder: str) -> DataFrame:
    return config.resolve_placeholders(v.templates(spark, folder), effective_config(spark, folder))


def fill_templates(spark: SparkSession, folder: str) -> DataFrame:
    return config.fill_templates(v.templates(spark, folder), effective_config(spark, folder))


def connection_inventory(spark: SparkSession, folder: str) -> DataFrame:
    return _joined(config.connection_inventory(v.connection_strings(spark, folder)), ", ", "missing")


def resolve_connection(spark: SparkSession, folder: str) -> DataFrame:
    resolved = config.resolve_connection(effective_config(spark, folder), v.secrets(spark, folder))
    return _joined(resolved, ", ", "missing")


def last_good_config_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The orders as files that arrive one after the other: three micro-batches, each of a file per task, upserts by customer."""
    files = v.tasks(spark)
    arriving = materialize(v.table(spark, folder, "orders").repartition(3 * files), "arriving-orders")
    stream = spark.readStream.schema(arriving.schema).option("maxFilesPerTrigger", files).parquet(v.folder_of(arriving))
    ledger = new_location(spark, "last-good-config")
    keep_last_good(v.config_versions(stream), ledger, new_location(spark, "last-good-state")).awaitTermination()
    return newest_config(spark, ledger)


def last_good_config_table(spark: SparkSession, folder: str) -> DataFrame:
    return last_good_config(v.config_versions(v.table(spark, folder, "orders")))


# --- chat -----------------------------------------------------------------------------------


def _requests(task: str, **details: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return chat.chat_requests(v.user_texts(spark, folder), task, "small-model", **details)

    return query


def chat_results(spark: SparkSession, folder: str) -> DataFrame:
    return chat.chat_results(v.chat_replies(spark, folder))


def chat_status_counts(spark: SparkSession, folder: str) -> DataFrame:
    return chat.status_counts(chat.chat_results(v.chat_replies(spark, folder)))


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        log_top_patterns, doc_top_patterns, log_summary, log_window_patterns, numbered_log_lines, doc_line_dedupe, cap_text, html_to_text,
        classify_build_lines, build_top_patterns, build_digest, build_failed,
        test_totals, test_failure_lines, test_summary_lines, test_digest,
        file_inventory, file_paths, walked_files, python_symbols, js_symbols, repo_map, todo_markers, todo_summary, scan_secrets,
        scan_secret_blocks, scan_random_values,
        deps_package_json, deps_requirements, deps_csproj, list_dependencies, dependency_counts,
        diff_files, diff_totals, diff_symbols, recent_commits, status_report,
        project_names, project_edges, dangling_references, adjacency, strong_components, find_cycles, one_repository_components, one_repository_cycles,
        layer_of, layer_violations, unassigned_projects,
        sarif_diagnostics, sarif_contexts, select_removable, keep_directive_lines, remove_lines, unreadable_logs, prune_report, prune_status,
        validate_moves, rename_namespaces, rename_by_table, update_header, rewrite_plan, gated_rewrite_plan, rewrite_summary, replaced_files,
        read_move_maps, map_moves, rewrite_plan_by_map,
        ddl_tables, list_tables, list_named_tables, table_names, describe_table, describe_tables,
        active_sessions, top_sql_by_cpu, top_sql_by_default, tablespace_usage, invalid_objects, snapshot_sql,
        env_entries, effective_config, resolve_placeholders, fill_templates, connection_inventory,
        resolve_connection, last_good_config_stream, last_good_config_table, chat_results, chat_status_counts,
    )
} | {
    "chat_summarize": _requests("summarize"),
    "chat_translate": _requests("translate", target="German"),
    "chat_classify": _requests("classify", categories="bug, feature, question"),
    "chat_draft": _requests("draft"),
    # Names from when the plain ones read a part of their tables.
    "update_header_all_files": update_header,
    "read_part_move_maps": read_move_maps,
    "map_part_moves": map_moves,
    "rewrite_plan_by_part_map": rewrite_plan_by_map,
}
