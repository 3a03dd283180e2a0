"""Embedding whitening with weighted multiplicity covariance.

Entries become integers on a grid. Identical vectors are one row with a count, and the covariance is a
weighted centred matrix product over these rows: the weights are the counts, or one for a fit in which
copies do not count. Each distinct vector is projected once; its rows get the result by a join.
Sums are exact; a task holds one matrix as wide as the vectors, and so does the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.llm.hot_groups import join_classes
from siftwork.sources.checkpoints import materialize, materialize_counting

SCALE, SHIFT = 64, 1_000_000
MOST = 1 << 40  # a grid value beyond is set to it
COMPONENTS = 32
_EXACT = pa.decimal128(38, 0)


@dataclass(frozen=True)
class Moments:
    """Of the vectors of one length: weight, sum per dimension, and the covariance (divisor: weight)."""

    n: int
    sums: list
    covariance: np.ndarray

    @property
    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        return _centre(self.sums, self.n)


def _centre(sums: list, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean as a whole part and a rest, so that centring integers loses nothing."""
    if isinstance(sums[0], float):
        return np.zeros(len(sums)), np.array([s / n for s in sums])
    whole = [s // n for s in sums]
    return np.array(whole, np.float64), np.array([(s - w * n) / n for s, w in zip(sums, whole)])


def grid(vector: Column) -> Column:
    """floor(64 * c) + 1000000 of every entry, as long."""
    scaled = F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("long"))
    return F.transform(scaled, lambda c: c + F.lit(SHIFT).cast("long"))


def sound(vector: str) -> Column:
    return F.expr(f"{vector} is not null and forall({vector}, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(matrix, weights) of the rows of each length in a batch of (vector, weight)."""
    for rows in batches:
        lists = rows.column(0)
        sizes = lists.value_lengths().to_numpy()
        flat, weights = lists.flatten().to_numpy(), rows.column(1).to_numpy()
        starts = np.cumsum(sizes) - sizes
        for d in np.unique(sizes).tolist():
            k = np.flatnonzero(sizes == d)
            yield flat[starts[k][:, None] + np.arange(d)], weights[k]


def _weighted_sums(vectors: DataFrame) -> dict[int, tuple[int, list]]:
    """By length of the vector: total weight and weighted sums, exact for integers."""
    whole = vectors.schema["vector"].dataType.elementType.typeName() == "long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for x, w in _matrices(batches):
            total = held.setdefault(x.shape[1], [0] * (x.shape[1] + 1))
            total[0] += int(w.sum())
            if whole:
                near = x - x[0]  # small numbers, so that no product with a count overflows
                safe = int(w.max()) * int(np.abs(near).max()) * len(w) < 1 << 62
                part = (w[:, None] * near).sum(0).tolist() if safe else (w.astype(object)[:, None] * near.astype(object)).sum(0).tolist()
                part = [p + int(first) * int(w.sum()) for p, first in zip(part, x[0].tolist())]
            else:
                part = (w @ x).tolist()
            for k, value in enumerate(part):
                total[k + 1] += value
        for d, total in held.items():
            values = pa.array([Decimal(t) for t in total], _EXACT) if whole else pa.array([float(t) for t in total], pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(total), pa.int32()), pa.array(range(-1, d), pa.int32()), values], ["d", "k", "total"])

    kind = "decimal(38,0)" if whole else "double"
    parts = vectors.mapInArrow(run, f"d int, k int, total {kind}").groupBy("d", "k").agg(F.sum("total").cast(kind).alias("total"))
    found: dict[int, dict[int, int | float]] = {}
    for row in parts.collect():  # one row per dimension
        found.setdefault(row["d"], {})[row["k"]] = int(row["total"]) if whole else row["total"]
    return {d: (int(t[-1]), [t[k] for k in range(d)]) for d, t in found.items()}


def weighted_moments(vectors: DataFrame) -> dict[int, Moments]:
    """Moments of `vectors(vector, weight)` by vector length; centred before multiplying."""
    sums = _weighted_sums(vectors)
    centres = {d: _centre(s, n) for d, (n, s) in sums.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for x, w in _matrices(batches):
            whole, rest = centres[x.shape[1]]
            z = (x - whole) - rest
            product = (z * w[:, None]).T @ z
            held[x.shape[1]] = held.get(x.shape[1], 0) + product
        for d, product in held.items():
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d, np.int32)), pa.array((i * d + j).astype(np.int64)), pa.array(product[i, j])], ["d", "cell", "value"])

    cells = vectors.mapInArrow(run, "d int, cell long, value double").groupBy("d", "cell").agg(F.sum("value").alias("value"))
    matrices = {d: np.zeros((d, d)) for d in sums}
    for row in cells.collect():  # half a matrix
        i, j = divmod(row["cell"], row["d"])
        matrices[row["d"]][i, j] = matrices[row["d"]][j, i] = row["value"]
    return {d: Moments(n, s, matrices[d] / n) for d, (n, s) in sums.items()}


def components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as rows; directions without variance are left out."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1].T
    there = values > max(values[0], 0) * len(values) * np.finfo(float).eps if len(values) else np.zeros(0, bool)
    values, vectors = values[there][:most], vectors[there][:most]
    largest = np.abs(vectors).argmax(1)
    return values, vectors * np.sign(vectors[np.arange(len(vectors)), largest])[:, None]


def _deviations(x: np.ndarray, n: int, sums: list) -> list[Decimal]:
    """sum((n * x - S)^2) of every row, exact."""
    if n * (int(np.abs(x).max()) + max(map(abs, sums)) // n + 1) < 1 << 62:
        away = n * x - np.array(sums, np.int64)
        if float(np.abs(away).max()) ** 2 * x.shape[1] < 2.0**62:
            return list(map(Decimal, (away * away).sum(1).tolist()))
        away = away.astype(object)
    else:
        away = n * x.astype(object) - np.array(sums, object)
    return list(map(Decimal, (away * away).sum(1).tolist()))


def _projected(classes: DataFrame, fit: dict[int, Moments], bases: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            lists, counts = rows.column(0), rows.column(1)
            sizes = lists.value_lengths().to_numpy()
            for d in np.unique(sizes).tolist():
                k = pa.array(np.flatnonzero(sizes == d))
                own = lists.take(k)
                x = own.flatten().to_numpy().reshape(-1, d)
                whole, rest = fit[d].centre
                values, vectors = bases[d]
                white = (((x - whole) - rest) @ vectors.T) / np.sqrt(values)
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(values))
                deviation = pa.array(_deviations(x, fit[d].n, fit[d].sums), _EXACT)
                yield pa.RecordBatch.from_arrays([own, counts.take(k), deviation, pa.ListArray.from_arrays(ends, pa.array(white.ravel()))], ["x", "size", "deviation", "white"])

    return classes.mapInArrow(run, "x array<long>, size long, deviation decimal(38,0), white array<double>")


def whiten(vectors: DataFrame, most: int = COMPONENTS, weigh_copies: bool = True) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every sound row of `vectors(vec_id, embedding)`.

    Rows whose vector is null, empty or holds null or non-finite entries are dropped; other rows,
    repeated ones and those without vec_id included, give up to `most` rows, one per component. Vectors
    of each length are fitted apart; n is the weight of their fit list (rows, or distinct
    vectors without `weigh_copies`). Components without variance do not exist, so equal vectors only give no
    row. Entries beyond 2^40 on the grid are set to it. deviation is an exact decimal of up to 38
    digits. Other columns are not read; an empty table gives none.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("embedding").alias("vector")).filter(sound("vector") & (F.size("vector") > 0))
    rows, total = materialize_counting(rows.select("vec_id", grid(F.col("vector")).alias("x")), "grid")
    classes = materialize(rows.groupBy("x").agg(F.count(F.lit(1)).alias("size")), "distinct")
    weight = F.col("size") if weigh_copies else F.lit(1).cast("long")
    fit = weighted_moments(classes.select(F.col("x").alias("vector"), weight.alias("weight")))
    bases = {d: components(m.covariance, most) for d, m in fit.items()}
    white = materialize(_projected(classes, fit, bases), "white")
    check = weighted_moments(white.filter("size(white) > 0").select(F.col("white").alias("vector"), weight.alias("weight")))
    known = []
    for d, (values, _) in bases.items():
        explained = (values / np.trace(fit[d].covariance)).tolist() if len(values) else []
        known.append((d, fit[d].n, explained))
    facts = spark.createDataFrame(known, "d int, n long, explained array<double>")
    errors = {k: float(np.abs(m.covariance - np.eye(k)).max()) for k, m in check.items()}
    off = F.lit(None).cast("double")
    for k, error in errors.items():
        off = F.when(F.size("white") == k, F.lit(error)).otherwise(off)
    each = join_classes(rows, white, ["x"], "size", total)
    each = each.withColumn("d", F.size("x")).withColumn("identity_error", off).join(F.broadcast(facts), "d")  # a row per vector length
    return each.select("vec_id", "n", "deviation", "identity_error", "explained", F.posexplode("white").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.expr("explained[at]").alias("explained"), "identity_error"
    )
