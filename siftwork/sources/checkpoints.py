"""Cutting lineage: intermediate tables written to the folder the cluster shares."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

DIR_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in `spark.checkpoint.dir`.

    A single-machine master without that setting uses a subfolder of its warehouse. On a cluster
    the setting is required: a machine's own folder would lose its tables with the machine.
    """
    configured = spark.conf.get(DIR_KEY, None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    raise ValueError(f"{DIR_KEY} must name a folder that every executor can reach")


def new_location(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/siftwork/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


_CLEAN_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go as soon as it ends; until then lost executors can be made good."""
    before = spark.conf.get(_CLEAN_KEY, "false")
    spark.conf.set(_CLEAN_KEY, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN_KEY, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """`df` written as a table of the shared folder and read back.

    The plan runs once, survives lost executors, and later joins see the table's true size.
    """
    location = new_location(df.sparkSession, name)
    with _shuffles_removed(df.sparkSession):
        df.write.parquet(location)
    return df.sparkSession.read.schema(df.schema).parquet(location)


def materialize_counting(df: DataFrame, name: str, condition: str = "true") -> tuple[DataFrame, int]:
    """`materialize`, and the number of rows that meet `condition`, counted while writing."""
    watch = Observation()
    table = materialize(df.observe(watch, F.count_if(F.expr(condition)).alias("n")), name)
    return table, watch.get["n"]


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by `materialize` that no later plan reads."""
    for table in tables:
        spark = table.sparkSession
        home = f"{shared_dir(spark)}/siftwork/{spark.sparkContext.applicationId}/"
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            if home.split(":", 1)[-1].lstrip("/") in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
