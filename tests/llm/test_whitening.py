"""Whitened vectors against a dense solution over all rows."""

import math

import numpy as np
import pytest

from siftwork.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def dense(vectors, most=32, weights=None):
    """n, deviations, |whitened|, explained of a list of equally long vectors, rows in order."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], object)
    fit = x if weights is None else np.array(list(dict.fromkeys(map(tuple, x.tolist()))), object)
    n, total = len(fit), fit.sum(0)
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, total)) for row in x.tolist()]
    mean = np.array([s / n - 1_000_000 for s in total.tolist()], np.float64)
    centred = (fit - 1_000_000).astype(np.float64) - mean
    covariance = centred.T @ centred / n
    values, basis = np.linalg.eigh(covariance)
    values, basis = values[::-1][:most], basis[:, ::-1][:, :most]
    white = (((x - 1_000_000).astype(np.float64) - mean) @ basis) / np.sqrt(values)
    return n, deviation, white, values / np.trace(covariance)


def compare(found, ids, vectors, most=32, weights=None):
    n, deviation, white, explained = dense(vectors, most, weights)
    rows = {(r["vec_id"], r["component"]): r for r in found.collect()}
    k = min(most, white.shape[1])
    assert len(rows) == len(ids) * k
    ours = np.array([[rows[i, c + 1]["whitened"] for c in range(k)] for i in ids])
    signs = np.sign((ours * white).sum(0))
    assert np.abs(ours - white * signs).max() < 1e-6
    for at, i in enumerate(ids):
        for c in range(k):
            row = rows[i, c + 1]
            assert (row["n"], int(row["deviation"])) == (n, deviation[at])
            assert abs(row["explained"] / explained[c] - 1) < 1e-9
    return next(iter(rows.values()))["identity_error"]


def sample(n, d, seed=1):
    rng = np.random.default_rng(seed)
    plain = (rng.standard_normal((n, d)) * np.linspace(0.05, 1.5, d)).astype(np.float32)
    return [plain[k % (n - n // 3)].tolist() for k in range(n)]  # a third are copies


@pytest.mark.parametrize(("n", "d"), [(400, 8), (300, 40)])
def test_equals_the_dense_solution(spark, n, d):
    vectors = sample(n, d) + [sample(n, d)[3]] * n  # one vector holds half of all rows
    ids = list(range(len(vectors)))
    table = spark.createDataFrame([(i, v, 0) for i, v in zip(ids, vectors)], SCHEMA).repartition(6)
    assert compare(whitening.whiten(table), ids, vectors) < 1e-9
    assert compare(whitening.whiten(table, most=3), ids, vectors, 3) < 1e-9
    assert compare(whitening.whiten(table, weigh_copies=False), ids, vectors, 32, "one") < 1e-9


def test_unsound_rows_go_and_others_stay(spark):
    good = sample(30, 3)
    nan, inf = float("nan"), float("inf")
    rows = [(i, v, 0) for i, v in enumerate(good)] + [(90, None, 1), (91, [1.0, None, 2.0], 1), (92, [nan, 0.0, 0.0], 1), (93, [0.0, inf, 0.0], 1), (94, [], 1), (95, [-inf] * 3, 1)]
    assert compare(whitening.whiten(spark.createDataFrame(rows, SCHEMA)), list(range(30)), good) < 1e-9


def test_null_and_repeated_ids_and_clashing_names(spark):
    good = sample(20, 3)
    rows = [(None if i < 2 else 7, v, 1.0, [2.0]) for i, v in enumerate(good)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>, x double, white array<double>")).collect()
    assert len(found) == 60 and sum(r["vec_id"] is None for r in found) == 6


def test_lengths_are_fitted_apart(spark):
    a, b = sample(40, 3), sample(50, 5, 2)
    table = spark.createDataFrame([(i, v, 0) for i, v in enumerate(a)] + [(100 + i, v, 0) for i, v in enumerate(b)], SCHEMA)
    found = whitening.whiten(table)
    compare(found.filter("vec_id < 100"), list(range(40)), a)
    compare(found.filter("vec_id >= 100"), list(range(100, 150)), b)


def test_no_variance_and_empty_tables(spark):
    assert whitening.whiten(spark.createDataFrame([(k, [1.0, 2.0], 0) for k in range(5)], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    flat = spark.createDataFrame([(k, [float(k % 4), 2.0], 0) for k in range(8)], SCHEMA)
    assert [r["component"] for r in whitening.whiten(flat).collect()] == [1] * 8


def test_huge_entries_stay_exact(spark):
    vectors = [[3.0e38, 1.0], [-3.0e38, 2.0], [0.5, 0.25], [1e9, -1e9]]
    found = whitening.whiten(spark.createDataFrame([(k, v, 0) for k, v in enumerate(vectors)], SCHEMA))
    most = 1 << 40
    x = [[max(-most, min(most, 64 * c)) for c in map(lambda c: float(np.float32(c)), v)] for v in vectors]
    x = [[math.floor(c) + 1_000_000 for c in v] for v in x]
    total = [sum(c) for c in zip(*x)]
    expected = [sum((4 * a - s) ** 2 for a, s in zip(v, total)) for v in x]
    assert {r["vec_id"]: int(r["deviation"]) for r in found.collect()} == dict(enumerate(expected))


def test_query_equals_the_dense_solution(spark):
    folder = "/root/testdata/sf0.001"
    rows = [r for r in queries.table(spark, folder, "embeddings").collect() if r["embedding"] is not None]
    found = queries.op13_embedding_whitening(spark, folder)
    assert dict(found.dtypes)["deviation"] == "bigint"
    assert compare(found, [r["vec_id"] for r in rows], [r["embedding"] for r in rows]) < 1e-4
