"""Embedding near-dedup: random-hyperplane sign hashing in several tables, then exact cosines.

Equal vectors are one row with a count. A table hashes a vector to the signs of its products with
random planes; vectors that share a bucket of any table are compared in double precision. A pair
that meets in several tables counts in the first. Planes grow with the logarithm of the number of
vectors, so buckets keep their size, and tables so that a pair at the threshold is missed
with probability `miss` at any size. Buckets of any size are cut into blocks, and tasks compare two blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.components import connected_components
from siftwork.sources.checkpoints import discard, materialize

COSINE = 0.9
BLOCK = 1024


def _plan(n: int, cosine: float, miss: float) -> tuple[int, int]:
    """Planes per table, tables."""
    planes = max(6, math.ceil(math.log2(max(1, n) / 64)) if n > 64 else 6)
    meet = (1 - math.acos(cosine) / math.pi) ** planes
    return planes, math.ceil(math.log(miss) / math.log(1 - meet))


def _coded(vectors: DataFrame, planes: int, tables: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            column = rows.column(2)
            sizes = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1])
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.cumsum(sizes) - sizes
            codes = np.zeros((len(rows), tables), np.int64)
            for d in np.unique(sizes).tolist():
                k = np.flatnonzero(sizes == d)
                x = flat[starts[k][:, None] + np.arange(d)]
                x = x / np.abs(x).max(1, keepdims=True)
                side = x @ np.random.default_rng([seed, d]).standard_normal((d, planes * tables)) > 0
                codes[k] = side.reshape(len(k), tables, planes) @ (1 << np.arange(planes, dtype=np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * tables, pa.int32()), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), column, lists], ["rep", "n", "vector", "codes"])

    kind = vectors.schema["vector"].dataType.simpleString()
    return vectors.select("rep", "n", "vector").mapInArrow(run, f"rep long, n long, vector {kind}, codes array<long>")


def _pairs(x: np.ndarray, block: np.ndarray, earlier: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one bucket with enough cosine that meet in no earlier table; of two blocks, only across."""
    x = x / np.abs(x).max(1, keepdims=True)
    norm = np.sqrt((x * x).sum(1))
    a, b = np.nonzero(x @ x.T >= (cosine - 1e-9) * norm[:, None] * norm[None, :])
    keep = (a < b) & ((block[a] != block[b]) if block.min() != block.max() else True)
    a, b = a[keep], b[keep]
    keep = (x[a] * x[b]).sum(1) / (norm[a] * norm[b]) >= cosine
    a, b = a[keep], b[keep]
    keep = ~(earlier[a] == earlier[b]).any(1)
    return a[keep], b[keep]


def _linked(buckets: DataFrame, cosine: float) -> DataFrame:
    """(rep, links, edge): parts of a vector's link count, and edges that keep linked vectors connected."""

    def settle(rows: pa.Table) -> pa.RecordBatch:
        rep, n, block = (rows.column(c).to_numpy() for c in ("rep", "n", "block"))
        vectors, codes = rows.column("vector").combine_chunks(), rows.column("earlier").combine_chunks()
        x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rep), -1)
        earlier = codes.flatten().to_numpy().reshape(len(rep), -1)
        two = rows.column("i")[0].as_py() != rows.column("j")[0].as_py()
        if two and block.min() == block.max():
            a = b = np.zeros(0, np.int64)
        else:
            a, b = _pairs(x, block if two else np.zeros(len(rep)), earlier, cosine)
        links = np.bincount(a, n[b], minlength=len(rep)) + np.bincount(b, n[a], minlength=len(rep))
        label = np.arange(len(rep))
        while len(a):  # least index reachable inside the bucket
            new = label.copy()
            np.minimum.at(new, a, label[b])
            np.minimum.at(new, b, label[a])
            new = new[new]
            if (new == label).all():
                break
            label = new
        hit = np.flatnonzero(links > 0)
        return pa.RecordBatch.from_arrays([pa.array(rep[hit]), pa.array(links[hit].astype(np.int64)), pa.array(rep[label[hit]])], ["rep", "links", "edge"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for rows in batches:
            if not len(rows):
                continue
            table = pa.Table.from_batches([*held, rows])
            key = np.stack([table.column(c).to_numpy() for c in keys])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist()]
            for start, stop in zip(cuts, cuts[1:]):
                if stop - start > 1:
                    yield settle(table.slice(start, stop - start))
            held = table.slice(cuts[-1]).combine_chunks().to_batches()
        if held and sum(map(len, held)) > 1:
            yield settle(pa.Table.from_batches(held))

    keys = ("table", "size", "code", "i", "j")
    n = int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return buckets.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, "rep long, links long, edge long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, miss: float = 0.002, block: int = BLOCK, seed: int = 11) -> DataFrame:
    """One row per row of `vectors(vec_id, embedding)`: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite numbers link with nothing and are
    kept; so are rows with a null vec_id, whose component_id is null and kept false. Vectors of
    different lengths are never compared. Rows that share vec_id and vector count as other vectors of
    each other. No other column is read; an empty table gives none.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").alias("vector"))
    sound = F.expr("vec_id is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vector, x -> x <> 0)")
    rows = rows.withColumn("ok", F.coalesce(sound, F.lit(False)))
    classes = materialize(rows.filter("ok").groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")), "vectors")
    planes, tables = _plan(classes.count(), cosine, miss)
    coded = materialize(_coded(classes, planes, tables, seed), "codes")
    spread = coded.select("rep", "n", "vector", F.size("vector").alias("size"), "codes", F.posexplode("codes").alias("table", "code"))
    large = coded.select(F.size("vector").alias("size"), F.posexplode("codes").alias("table", "code")).groupBy("table", "size", "code").count().filter(F.col("count") > block)
    large = materialize(large.select("table", "size", "code", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "large")
    keyed = spread.join(large, ["table", "size", "code"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    keyed = keyed.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    buckets = keyed.select(
        "table", "size", "code", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "n", "vector", F.expr("slice(codes, 1, table)").alias("earlier")
    )
    found = materialize(_linked(buckets, cosine), "links")
    groups = connected_components(found.select(F.col("rep").alias("a"), F.col("edge").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = classes.join(counts, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    named = materialize(named.select("vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")), "classes")
    discard(coded, large)
    joined = rows.filter("ok").join(named, "vector").select("vec_id", "n_links", F.col("component").alias("component_id"))
    alone = rows.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
