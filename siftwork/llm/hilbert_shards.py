"""Sharding by Hilbert order: rows close in several metadata dimensions share files.

Each dimension is cut into cells of about equal row counts, the cells' numbers give a place on a
Hilbert curve, and the curve is cut into runs. A run covers a compact region of every dimension, so
the minimum and maximum of a file's columns rule out most files for filters on any of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwork.llm.order import with_place
from siftwork.sources.checkpoints import materialize


def curve_place(cells: Sequence[np.ndarray], bits: int) -> np.ndarray:
    """The place on the Hilbert curve of points with `bits`-bit coordinates; len(cells) * bits <= 62."""
    x = [np.asarray(c, np.int64).copy() for c in cells]
    for q in (1 << k for k in range(bits - 1, 0, -1)):  # undo the turns, coarse to fine
        for axis in x:
            set_bit = (axis & q) != 0
            swap = np.where(set_bit, 0, (x[0] ^ axis) & (q - 1))
            x[0] ^= np.where(set_bit, q - 1, swap)
            if axis is not x[0]:
                axis ^= swap
    for a, b in zip(x, x[1:]):  # Gray code
        b ^= a
    turn = np.zeros_like(x[0])
    for q in (1 << k for k in range(bits - 1, 0, -1)):
        turn ^= np.where(x[-1] & q, q - 1, 0)
    place = np.zeros_like(x[0])
    for k in range(bits - 1, -1, -1):
        for axis in x:
            place = (place << 1) | (((axis ^ turn) >> k) & 1)
    return place


def _code(name: str, kind: T.DataType) -> Column:
    """What orders a dimension: numbers, or whole strings as bytes; null before everything."""
    c = F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        return F.coalesce(c, F.lit("")).cast("binary")
    return F.coalesce(c.cast("double"), F.lit(-1e300))


def _borders(code: Column, df: DataFrame, cells: int) -> np.ndarray:
    """The upper borders of about `cells` cells of equal row counts."""
    if not isinstance(df.select(code).schema[0].dataType, T.BinaryType):
        shares = [k / cells for k in range(1, cells)]
        found = df.agg(F.percentile_approx(code, shares, 10_000)).first()[0]
        return np.unique(np.array(found or [], float))
    # Distinct strings are counted, cut into ranges in order and added up within; the ranges' sums then add up.
    counted = materialize(df.groupBy(code.alias("_value")).agg(F.count(F.lit(1)).alias("_n")), "values")
    ranged = materialize(counted.repartitionByRange("_value").withColumn("_range", F.spark_partition_id()), "value-ranges")
    sums = ranged.groupBy("_range").agg(F.sum("_n").alias("_sum"))
    before = F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")  # one row per range
    inner = F.sum("_n").over(Window.partitionBy("_range").orderBy("_value")) - F.col("_n")
    total = ranged.agg(F.sum("_n")).first()[0] or 1
    placed = ranged.withColumn("_inner", inner).join(sums.select("_range", before.alias("_before")), "_range")
    cell = F.expr(f"(_before + _inner) * {cells} div {total}")
    found = placed.groupBy(cell.alias("_cell")).agg(F.max("_value").alias("_border")).collect()  # at most `cells` rows
    out = np.empty(len(found), object)
    out[:] = sorted(bytes(r["_border"]) for r in found)
    return out


def with_curve(df: DataFrame, dimensions: Sequence[str], bits: int = 6) -> DataFrame:
    """`df`, a written table, and `_curve`, its rows' places on the curve.

    Cell borders are quantiles over all rows, exact for strings, which count whole, and approximate for
    numbers: at most 2^bits values per dimension are gathered. Many equal values share one cell.
    Columns named `_curve` or `_d<number>` are written over.
    """
    codes = {f"_d{k}": _code(d, df.schema[d].dataType) for k, d in enumerate(dimensions)}
    borders = {n: _borders(c, df, 1 << bits) for n, c in codes.items()}
    kept = [f for f in df.schema if f.name not in (*codes, "_curve")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            cells = []
            for name, border in borders.items():
                values = rows.column(rows.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
                cells.append(np.minimum(np.searchsorted(border, values, "left"), (1 << bits) - 1))
            rest = rows.select([f.name for f in kept])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(curve_place(cells, bits))], [*rest.schema.names, "_curve"])

    return df.withColumns(codes).mapInArrow(run, T.StructType([*kept, T.StructField("_curve", T.LongType())]))


def shard_rows(df: DataFrame, dimensions: Sequence[str], shards: int, bits: int = 6, ties: Sequence[str] = ()) -> DataFrame:
    """`df` with `shard` (0 to shards - 1) and `slot` (gapless from 0 in each shard), one row per row.

    Runs of the curve hold equal counts of rows, at most one apart. Rows of one cell follow `ties`;
    equal rows keep an arbitrary order. Null values come first in their dimension; an empty table
    gives none. Columns of any names are kept, but `shard` and `slot` are written over. The rows are
    written before they are ranged: pass only columns that are needed.
    """
    named = lambda names, mark: {f"{mark}{k}": F.col(f"`{n}`") for k, n in enumerate(names)}
    keys, breakers = named(dimensions, "key"), named(ties, "tie")
    rest = F.struct(*[f"`{c}`" for c in df.columns if c not in ("shard", "slot")])
    packed = df.select(rest.alias("rest"), *[c.alias(n) for n, c in {**keys, **breakers}.items()])
    table = materialize(packed.withColumn("row", F.monotonically_increasing_id()), "rows")
    curve = materialize(with_curve(table, list(keys), bits).drop(*keys), "curve")
    placed = with_place(curve, "_curve", *breakers, "row")
    n = max(1, curve.count())
    out = placed.withColumn("shard", F.expr(f"int(place * {shards} div {n})"))
    return out.select("rest.*", "shard", (F.col("place") - F.expr(f"(shard * {n}L + {shards - 1}) div {shards}")).alias("slot"))
