"""Places of rows in a total order, without gathering them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.llm.names import free
from siftwork.sources.checkpoints import materialize


def with_place(df: DataFrame, *keys: Column | str, name: str = "place") -> DataFrame:
    """`df` with the gapless place (from 0) of each row in the order of `keys`.

    `df` should be a written table, as range partitioning samples it first. Rows are cut into
    ranges and numbered within; the counts of the ranges, one row each, are then added up. Keys
    should tell rows apart, else equal rows share a range.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    at_name, part_name, start_name = (free(c, [*df.columns, name]) for c in ("_at", "_part", "_start"))
    table = materialize(ranged.withColumn(at_name, F.monotonically_increasing_id()), "ranges")
    part = F.shiftright(at_name, 33)
    sizes = table.groupBy(part.alias("_part")).count().collect()  # one row per range
    before, starts = 0, []
    for row in sorted(sizes):
        starts.append((row["_part"], before))
        before += row["count"]
    offsets = spark.createDataFrame(starts, f"{part_name} long, {start_name} long")
    placed = table.withColumn(part_name, part).join(F.broadcast(offsets), part_name)  # as many rows as ranges
    place = F.col(start_name) + F.col(at_name).bitwiseAND((1 << 33) - 1)
    return placed.withColumn(name, place).drop(part_name, start_name, at_name)
