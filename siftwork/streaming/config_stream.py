"""Settings that change while others read them: a broken version never replaces a good one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftwork.operators.config import settings_connection


def judge_versions(versions: DataFrame) -> DataFrame:
    """(repo, version, text) with `error`: NULL for a usable version, else what is wrong.

    A text without any connection is as unusable as a half-filled one.
    """
    choice = settings_connection(F.col("text"))
    judged = versions.withColumn("_c", choice)
    error = F.when(F.col("_c").isNull(), "no connection configured").when(
        F.col("_c.status") != "ok", F.concat_ws(" ", "_c.status", F.array_join("_c.missing", ", "))
    )
    return judged.withColumn("error", F.trim(error)).drop("_c")


def last_good_config(versions: DataFrame) -> DataFrame:
    """Per repository the newest usable version and the newest error after it:
    (repo, good_version, text, latest_version, latest_error).

    Works on a stream (update mode; the state is one row per repository) as well as on a table. `latest_error` is NULL when the newest version is the good one.
    """
    judged = judge_versions(versions)
    good_version = F.when(F.col("error").isNull(), F.col("version"))
    kept = judged.groupBy("repo").agg(
        F.max(good_version).alias("good_version"),
        F.max_by("text", good_version).alias("text"),
        F.max("version").alias("latest_version"),
        F.max_by(F.struct("error"), "version").alias("_latest"),
    )
    return kept.select("repo", "good_version", "text", "latest_version", F.col("_latest.error").alias("latest_error"))


def keep_last_good(versions: DataFrame, ledger: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Follows a stream of versions: each micro-batch adds the repositories it has a version of to the `ledger` folder.

    The state, one row per repository, lives in `checkpoint`, so a restart goes on where the last run stopped.
    A batch that is repeated after a failure replaces its own part of the ledger. `trigger` is
    passed on; without it, what there is now is read and the query ends.
    """
    kept = last_good_config(versions)
    empty = versions.sparkSession.createDataFrame([], kept.schema)
    empty.write.mode("ignore").parquet(f"{ledger}/batch_id=-1")
    return (
        kept.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{ledger}/batch_id={batch_id}"))
        .start()
    )


def newest_config(spark: SparkSession, ledger: str) -> DataFrame:
    """`last_good_config` as of the last micro-batch that `keep_last_good` wrote."""
    rows = spark.read.parquet(ledger)
    columns = [c for c in rows.columns if c != "batch_id"]
    return rows.groupBy("repo").agg(F.max_by(F.struct(*columns), "batch_id").alias("_row")).select("_row.*")
