"""Smaller Arrow batches while an operator runs, so that long texts and sets bound a task's memory."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES_KEY, _BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"
_READ_KEY, _READ = "spark.sql.parquet.columnarReaderBatchSize", 512


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """At most `rows` rows and about 4 MB to a batch for the jobs that run inside; the session's own settings return after.

    Parquet is read by `_READ` rows at a time: its reader holds the texts of a batch in one array, which
    doubles as it grows, and arrays of tens of MB make the heap grow far beyond what is alive in it.
    """
    before = {key: spark.conf.get(key) for key in (_KEY, _BYTES_KEY, _READ_KEY)}
    spark.conf.set(_KEY, str(min(rows, int(before[_KEY])) if int(before[_KEY]) > 0 else rows))
    spark.conf.set(_BYTES_KEY, _BYTES)
    spark.conf.set(_READ_KEY, str(min(_READ, int(before[_READ_KEY]))))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
