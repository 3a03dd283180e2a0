"""Readers: files as rows, big text files as lines."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwork.functions import paths
from siftwork.functions import text as tx
from siftwork.sources.checkpoints import materialize
from siftwork.sources.tree import FolderTree, extension

_ROWS_PER_PARTITION_BITS = 33


def read_files(
    spark: SparkSession,
    root: str,
    exclude_dirs: Iterable[str] = (),
    exts: Iterable[str] = (),
    skip_hidden: bool = False,
    repo_depth: int = 0,
) -> DataFrame:
    """Files under `root` as (repo, path, content BINARY).

    The first `repo_depth` folders below the root name the repository, the rest is the path.
    Extensions and folders are tested on the file listing, so bytes of other files are not read.
    Spark's scans pass over names that begin with `_` or `.`; where those count, as `__init__.py`
    does in a source tree, use `walk_files`.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    extensions = [e.lstrip(".") for e in exts]
    if extensions:
        # Hadoop globs are case-sensitive; a character class per letter is not.
        either_case = ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions)
        reader = reader.option("pathGlobFilter", f"*.{{{either_case}}}")
    # The metadata path is URI-encoded; `+` stands for itself in it.
    decoded = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    relative = F.regexp_replace(decoded, f"^.*?{_quoted_tail(root)}/+", "")
    files = reader.load(root)
    excluded = list(exclude_dirs)
    if excluded:
        files = files.filter(~paths.in_any_folder(relative, excluded))
    if skip_hidden:
        files = files.filter(~paths.in_hidden_folder(relative))
    return files.select(*_repo_and_path(root, repo_depth), "content")


def _repo_and_path(root: str, repo_depth: int) -> tuple[Column, Column]:
    parts = F.split(_relative_to(F.col("path"), root), "/")
    repo = F.array_join(F.slice(parts, 1, repo_depth), "/") if repo_depth else F.lit("")
    return repo.alias("repo"), F.array_join(F.slice(parts, F.lit(repo_depth + 1), F.size(parts)), "/").alias("path")


def walk_files(
    spark: SparkSession,
    root: str,
    exclude_dirs: Iterable[str] = (),
    exts: Iterable[str] = (),
    skip_hidden: bool = False,
    repo_depth: int = 0,
) -> DataFrame:
    """The same table as `read_files`, with every file name included.

    The data source `folder_tree` lists in one job, without entering excluded folders or keeping
    names of other extensions; the list is written, spread evenly, and contents are read where
    their paths were sent. `root` is an absolute path or a URI the workers can open.
    """
    files = walk_names(spark, root, exclude_dirs, exts, skip_hidden)

    def read_contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as arrow_fs

        store = arrow_fs.FileSystem.from_uri(root)[0]
        for path in (p for batch in batches for p in batch["path"]):
            with store.open_input_stream(path) as stream:
                yield pd.DataFrame({"path": [path], "content": [stream.read()]})

    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    contents = files.select("path").repartition(pieces).mapInPandas(read_contents, "path string, content binary")
    return contents.select(*_repo_and_path(root, repo_depth), "content")


def walk_names(
    spark: SparkSession, root: str, exclude_dirs: Iterable[str] = (), exts: Iterable[str] = (), skip_hidden: bool = False
) -> DataFrame:
    """The files under `root` as (path, extension, size), listed once."""
    spark.dataSource.register(FolderTree)
    tree = spark.read.format("folder_tree").option("exclude", "/".join(exclude_dirs)).option("skipHidden", str(skip_hidden).lower())
    files = tree.option("tasks", spark.conf.get("spark.sql.shuffle.partitions")).load(root)
    endings = [e.lower() for e in exts]
    if endings:
        if all("." in e for e in endings):
            files = files.filter(F.col("extension").isin(sorted({extension(e) for e in endings})))
        files = files.filter(reduce(or_, [F.lower("path").endswith(e) for e in endings]))
    key = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        return materialize(files, "listing")
    finally:
        spark.conf.set(key, before)


def _quoted_tail(root: str) -> str:
    path = root.split("://", 1)[-1].removeprefix("file:").rstrip("/")
    return r"\Q" + path + r"\E"


def _relative_to(path: Column, root: str) -> Column:
    return F.regexp_replace(path, f"^.*?{_quoted_tail(root)}/+", "")


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Splittable text files as (source, line_no, line).

    `line_no` only orders the lines of a file: the byte offset of the split the line was read
    from, then its place in that split. A decimal keeps both, and a decimal (unlike a struct)
    can live in a hash aggregate's buffer.
    """
    in_partition = F.monotonically_increasing_id().bitwiseAND((1 << _ROWS_PER_PARTITION_BITS) - 1)
    order = F.col("_metadata.file_block_start").cast("decimal(20,0)") * F.lit(1 << _ROWS_PER_PARTITION_BITS).cast(
        "decimal(17,0)"
    ) + in_partition.cast("decimal(38,0)")
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source"),
        order.cast("decimal(38,0)").alias("line_no"),
        tx.make_clean(F.col("value")).alias("line"),
    )


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Splittable text files as (source, line_no, line), `line_no` from 1 without gaps in each file.

    The lines of each split are counted first; what the splits before hold is added up over one row per
    split, and lines are numbered where they are read. Both passes see the same splits as long as files
    and settings stay; no file passes through one task.
    """
    place = F.monotonically_increasing_id().bitwiseAND((1 << _ROWS_PER_PARTITION_BITS) - 1)
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("_split"), place.alias("_place"), F.col("value")
    )
    splits = lines.groupBy("source", "_split").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("source").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return lines.join(starts, ["source", "_split"]).select(
        "source", (F.col("_before") + F.col("_place") - F.col("_first") + 1).alias("line_no"), tx.make_clean(F.col("value")).alias("line")
    )


def register_tables(spark: SparkSession, folder: str, names: Iterable[str]) -> None:
    """Parquet tables of one folder as temporary views, for `run_sql`."""
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)


def run_sql(spark: SparkSession, statement: str) -> DataFrame:
    """Any statement over the registered snapshot tables."""
    return spark.sql(statement)
