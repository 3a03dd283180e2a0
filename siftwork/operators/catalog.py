"""Database catalogs: tables declared in scripts, and queries over catalog snapshot tables.

Snapshot tables carry the columns of the database's own views (lower case).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.functions import text as tx

# Segment types, system owners, metrics, megabyte.
TABLE_SEGMENTS = ("TABLE", "TABLE PARTITION", "TABLE SUBPARTITION")
SYSTEM_OWNERS = ("SYS", "SYSTEM")
SQL_METRICS = ("cpu_time", "disk_reads", "buffer_gets", "elapsed_time")
MEGABYTE = 1024 * 1024
MICROSECONDS = 1000000


def ddl_tables(scripts: DataFrame, limit: int | None = None) -> DataFrame:
    """CREATE TABLE statements of (script, text): (script, pos, table, columns ARRAY<STRING>).

    A column is a name and a type at the start of a line, so a constraint line counts as one; with
    `limit` only the first columns of a table are listed.
    """
    s, w = tx.SPACE, tx.WORD
    create = (
        f"(?isu)CREATE{s}+TABLE{s}+(?:IF{s}+NOT{s}+EXISTS{s}+)?[`\"\\[]?({w}+)[`\"\\]]?{s}*\\((.*?)\\){s}*;"
    )
    column = f"(?md)^{tx.INLINE_SPACE}*[`\"\\[]?({w}+)[`\"\\]]?{s}+[A-Za-z]+"
    statements = scripts.filter(F.contains(F.lower("text"), F.lit("create"))).select(
        "script", F.posexplode(F.regexp_extract_all("text", F.lit(create), F.lit(0))).alias("_pos", "_statement")
    )
    body = F.regexp_extract("_statement", create, 2)
    columns = F.regexp_extract_all(body, F.lit(column), F.lit(1))
    return statements.select(
        "script",
        (F.col("_pos") + 1).cast("bigint").alias("pos"),
        F.regexp_extract("_statement", create, 1).alias("table"),
        (columns if limit is None else F.slice(columns, 1, limit)).alias("columns"),
    )


def list_tables(tables: DataFrame, segments: DataFrame, names_csv: str = "") -> DataFrame:
    """(table_name, segment_size_bytes, num_rows, last_analyzed); all tables without names.

    Segments add up before the join, so the join sees one row per segment name.
    """
    if names_csv:
        tables = tables.filter(F.col("table_name").isin(names_csv.split(",")))
    sizes = (
        segments.filter(F.col("segment_type").isin(*TABLE_SEGMENTS))
        .groupBy(F.col("segment_name").alias("table_name"))
        .agg(F.sum("bytes").alias("_bytes"))
    )
    return (
        tables.join(sizes, "table_name", "left")
        .groupBy("table_name", "num_rows", "last_analyzed")
        .agg(F.coalesce(F.sum("_bytes"), F.lit(0)).alias("segment_size_bytes"))
        .select("table_name", "segment_size_bytes", "num_rows", "last_analyzed")
    )


def table_names(tables: DataFrame) -> DataFrame:
    return tables.select("table_name")


def describe_table(columns: DataFrame, table: str) -> DataFrame:
    """Columns of one table in order: (column_name, data_type, nullable)."""
    return (
        columns.filter(F.col("table_name") == table).orderBy("column_id").select("column_name", "data_type", "nullable")
    )


def describe_tables(columns: DataFrame) -> DataFrame:
    """Every column of every table: (table_name, column_id, column_desc), desc as `name TYPE`."""
    desc = F.concat_ws(" ", "column_name", "data_type")
    return columns.select("table_name", "column_id", desc.alias("column_desc"))


def active_sessions(sessions: DataFrame, sql: DataFrame, own_audsid: int, limit: int | None = None) -> DataFrame:
    """Active sessions with their statement text, the `limit` longest-running ones if given.

    With a limit, sessions are cut first and only their statements are read for the join. Statements
    may repeat per sql_id, hence the second cut.
    """
    shown = ["sid", "serial", "username", "osuser", "program", "status", "wait_class", "event"]
    order = [F.desc("last_call_et"), F.col("sid"), F.col("serial")]
    active = sessions.filter((F.col("status") == "ACTIVE") & (F.col("audsid") != own_audsid))
    texts = sql.select("sql_id", "sql_text")
    if limit is None:
        return active.join(texts, "sql_id", "left").select(*shown, "sql_text")
    longest = active.orderBy(*order).limit(limit)
    texts = texts.join(longest.select("sql_id"), "sql_id", "left_semi")
    return longest.join(texts, "sql_id", "left").orderBy(*order).limit(limit).select(*shown, "sql_text")


def top_sql_by(sql: DataFrame, metric: str = "elapsed_time", n: int = 5) -> DataFrame:
    """The `n` most expensive statements by a metric; an unknown metric means elapsed time."""
    by = metric.lower() if metric.lower() in SQL_METRICS else "elapsed_time"
    return (
        sql.orderBy(F.desc_nulls_first(by), "sql_id")
        .limit(n)
        .select(
            "sql_id",
            "executions",
            "buffer_gets",
            "disk_reads",
            (F.col("cpu_time") / MICROSECONDS).alias("cpu_seconds"),
            (F.col("elapsed_time") / MICROSECONDS).alias("elapsed_seconds"),
        )
    )


def tablespace_usage(data_files: DataFrame, free_space: DataFrame) -> DataFrame:
    """(tablespace_name, total_mb, free_mb, used_pct), fullest first by number.

    A tablespace without free-space rows has NULL free space, as in the source query.
    """
    total = data_files.groupBy("tablespace_name").agg(F.sum("bytes").alias("total"))
    free = free_space.groupBy("tablespace_name").agg(F.sum("bytes").alias("free"))
    return (
        total.join(free, "tablespace_name", "left")
        .select(
            "tablespace_name",
            F.round(F.col("total") / MEGABYTE, 2).alias("total_mb"),
            F.round(F.col("free") / MEGABYTE, 2).alias("free_mb"),
            F.round((F.col("total") - F.col("free")) / F.col("total") * 100, 2).alias("used_pct"),
        )
        .orderBy(F.desc_nulls_first("used_pct"), "tablespace_name")
    )


def invalid_objects(objects: DataFrame) -> DataFrame:
    """(owner, object_type, object_name, status) of invalid objects outside the system schemas."""
    return (
        objects.filter((F.col("status") == "INVALID") & ~F.col("owner").isin(*SYSTEM_OWNERS))
        .select("owner", "object_type", "object_name", "status")
        .orderBy("owner", "object_type", "object_name")
    )
