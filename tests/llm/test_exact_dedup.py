"""Copies found by merged digest runs against plain grouping."""

import hashlib
import random
import re

import duckdb
import pytest

from siftwork.llm import exact_dedup, queries
from siftwork.llm.oracles import ORACLES


def brute(rows):
    shape = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = {}
    for (i, _), s in zip(rows, shape):
        groups.setdefault(s, []).append(i)
    out = []
    for s, ids in groups.items():
        order = sorted(ids, key=lambda i: (i is None, i or 0))
        for k, i in enumerate(order):
            out.append((i, order[0], len(ids), k == 0, hashlib.sha256(s.encode()).hexdigest()))
    return key(out)


def key(rows):
    return sorted(rows, key=lambda r: (r[4], r[0] is None, r[0] or 0, not r[3]))


def found(df):
    return key([tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in df.collect()])


def mixed(n):
    random.seed(n)
    bodies = ["", " ", None, "a b", "a  b", "a\tb", "a b ", " a b", "A b", "é x", "long " * 5000] + [f"text {k % 37}" for k in range(200)]
    rows = [(k, random.choice(bodies)) for k in range(n)] + [(n + k, "hot  text") for k in range(n)]
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize("bits", [1, 2, 3])
@pytest.mark.parametrize("partitions", [1, 3, 13])
def test_groups_equal_plain_grouping(spark, documents, bits, partitions):
    rows = mixed(300)
    assert found(exact_dedup.exact_groups(documents(*rows).repartition(partitions), bits)) == brute(rows)


def test_null_and_repeated_ids_keep_one_row(spark):
    rows = [(5, "x"), (5, "x"), (None, "x"), (None, "y"), (None, "y"), (2, None), (3, ""), (4, " "), (9, "z")]
    docs = spark.createDataFrame([(i, t, 1, "d") for i, t in rows], "doc_id long, text string, row int, digest string")
    assert found(exact_dedup.exact_groups(docs)) == brute(rows)
    kept = exact_dedup.first_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, "y"), (2, ""), (4, " "), (5, "x"), (9, "z")]


def test_empty_table(spark, documents):
    assert found(exact_dedup.exact_groups(documents((1, "x")).limit(0))) == []


def test_entries_with_another_witness_do_not_fold(spark):
    """A digest that two texts share keeps them apart."""
    one, two = bytearray(b"\1" * 24), bytearray(b"\2" * 24)
    rows = [(p, bytearray(b"\0" * 32), w, False, d, r, 1) for p, w, d, r in [(0, one, 4, 0), (1, two, 3, 1), (2, one, 2, 2), (3, two, 9, 3)]]
    runs = spark.createDataFrame(rows, "place long, digest binary, witness binary, no_id boolean, doc_id long, row long, n long").repartition(4)
    merged = exact_dedup.merge_runs(exact_dedup._fold(runs), 8, 1)
    assert sorted((bytes(r["witness"])[0], r["doc_id"], r["row"], r["n"]) for r in merged.collect()) == [(1, 2, 2, 2), (2, 3, 1, 2)]


def test_a_hot_text_is_one_entry_of_a_run(spark, documents):
    """No task of a round meets more entries of one text than the runs of its group."""
    rows = exact_dedup._digests(documents(*[(k, "same") for k in range(2000)]).repartition(16))
    first = exact_dedup._fold(rows.selectExpr("bigint(spark_partition_id()) as place", "digest", "witness", "false as no_id", "doc_id", "row", "1L as n"))
    assert first.count() == 16
    assert [(r["doc_id"], r["n"]) for r in exact_dedup.merge_runs(first, 16, 2).collect()] == [(0, 2000)]


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    theirs = db.execute("SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM (" + ORACLES["op12_exact_dedup"] + ")").fetchall()
    assert found(queries.op12_exact_dedup(spark, folder)) == key(theirs)
