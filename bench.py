"""Seconds per headline query at one data folder; prints one JSON line.

Each query runs once to the end with every output column computed and nothing kept.
"""

from __future__ import annotations

import json
import os
import sys
import time

from siftwork.plans.queries import QUERIES
from siftwork.session import build_session

HEADLINE = (
    "log_top_patterns", "log_summary", "doc_line_dedupe", "html_to_text",
    "build_top_patterns", "build_digest", "build_failed", "test_totals", "test_failure_lines", "test_digest",
    "python_symbols", "repo_map", "todo_markers", "todo_summary", "scan_secrets",
    "list_dependencies", "diff_totals", "diff_symbols", "recent_commits", "status_report",
    "project_edges", "dangling_references", "layer_violations", "find_cycles",
    "sarif_diagnostics", "select_removable", "remove_lines", "prune_report",
    "validate_moves", "rename_namespaces", "rewrite_plan",
    "ddl_tables", "list_tables", "active_sessions", "top_sql_by_cpu", "tablespace_usage", "invalid_objects",
    "effective_config", "fill_templates", "resolve_connection", "last_good_config_stream",
    "chat_summarize", "chat_results",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"),
        spark__ui__enabled="false",
        spark__checkpoint__dir=os.environ.get("BENCH_SHARED_DIR", os.path.join(os.getcwd(), "spark-warehouse", "_bench")),
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # the first job of a session also starts it
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": folder.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
