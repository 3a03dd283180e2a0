"""Connected components of an undirected graph given as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from siftwork.sources.checkpoints import discard, materialize


def _mark(df: DataFrame) -> tuple[DataFrame, Observation]:
    watch = Observation()
    key = F.xxhash64("u", "v")
    return df.observe(watch, F.count(F.lit(1)).alias("n"), F.sum(F.expr("xxhash64(u, v) % 1000000007")).alias("s"), F.bit_xor(key).alias("x")), watch


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges(a, b)`: the smallest node reachable from it.

    Alternates large and small stars: every node hands its neighbours to the smallest node it
    sees, until only stars are left. Each round is one table of the shared folder, with at most
    one row per edge; rounds grow with the logarithm of a component's width, and a node of
    any degree is only grouped with partial sums or joined to one row. Null ends and loops drop out.
    """
    pair = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    stars, before = pair.filter("u is not null and v is not null and u <> v").distinct(), None
    marked, watch = _mark(stars)
    table = materialize(marked, "edges")
    while True:
        state = watch.get
        if state == before or state["n"] == 0:
            break
        before = state
        both = table.union(table.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # every large-star row already points from a node to a smaller one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.union(least.select("u", F.col("m").alias("v")))
        marked, watch = _mark(small.distinct())
        old, table = table, materialize(marked, "stars")
        discard(old)
    roots = table.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return table.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
