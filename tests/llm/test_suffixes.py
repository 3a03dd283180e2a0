"""Suffix arrays, common prefixes and repeated strings against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from siftwork.llm import suffix_dedup
from siftwork.llm.induced_sort import permuted_prefixes, suffix_array


@pytest.mark.parametrize("symbols", [1, 2, 4, 3000])
def test_suffix_array_and_prefixes(symbols):
    rng = np.random.default_rng(symbols)
    for n in (1, 2, 3, 17, 60):
        for t in (rng.integers(1, symbols + 1, n), np.tile(rng.integers(1, symbols + 1, 3), n)):
            t = np.concatenate((t, [0]))
            order = suffix_array(t)
            assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
            shared = permuted_prefixes(t, order, 15)
            for a, b in zip(order, order[1:]):
                same = t[a : len(t) - max(0, b - a)][: len(t) - b] == t[b:][: len(t) - a]
                assert shared[b] == min(15, len(same) if same.all() else int(np.argmin(same)))


def brute(rows, width):
    bodies = [(t or "").encode() for _, t in rows]
    seen = Counter(b[k : k + width] for b in bodies for k in range(len(b) - width + 1))
    out = []
    for (i, _), b in zip(rows, bodies):
        covered = [False] * len(b)
        for k in range(len(b) - width + 1):
            if seen[b[k : k + width]] > 1:
                covered[k : k + width] = [True] * width
        spans = sum(c and not p for c, p in zip(covered, [False, *covered]))
        kept = bytes(x for x, c in zip(b, covered) if not c)
        out.append((i, len(b), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def report(df, **options):
    return sorted((tuple(r) for r in suffix_dedup.repeat_report(df, **options).collect()), key=str)


def sample(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 7)))
    passage = [" ".join(word() for _ in range(n)) for n in (30, 60, 90)]
    texts = []
    for _ in range(25):
        parts = [" ".join(word() for _ in range(rng.randrange(5, 60))) for _ in range(3)]
        parts.insert(rng.randrange(4), rng.choice(passage)[rng.randrange(30) :])
        texts.append(" ".join(parts))
    return texts + [texts[0], "x" * 700, "abcabcabd" * 60, "y" * 199, "y" * 200, "", None, texts[1][5:]]


@pytest.mark.parametrize("width, shard_contexts", [(200, 1 << 14), (200, 1), (50, 4), (20, 1 << 14)])
def test_repeats(documents, width, shard_contexts):
    rows = list(enumerate(sample(width)))
    assert report(documents(*rows), width=width, shard_contexts=shard_contexts) == brute(rows, width)


def test_repeated_rows_nulls_and_clashing_columns(documents):
    text = sample(9)[0] * 2
    rows = [(1, text), (1, text), (None, text), (2, "short")]
    df = documents(*rows).withColumnsRenamed({"lang": "row", "source": "spans"})
    assert report(df) == brute(rows, 200)
    assert report(documents()) == []


def test_cut_texts_keep_rows_columns_and_whole_characters(documents):
    shared = "é" * 150
    df = documents((1, "start " + shared + " end"), (2, "x" + shared), (3, None), (4, "alone"))
    found = {r["doc_id"]: r["text"] for r in suffix_dedup.without_repeats(df).collect()}
    assert found == {1: "start  end", 2: "x", 3: None, 4: "alone"}
    assert suffix_dedup.without_repeats(df).columns == df.columns


def test_equal_rows_share_one_list_of_spans(documents):
    text = sample(4)[0] + sample(5)[1]
    df = documents(*[(k % 2 or None, text) for k in range(600)])
    found = suffix_dedup._with_spans(df, 200, 1 << 14).selectExpr("size(_spans) AS n").distinct().collect()
    assert len(found) == 1 and found[0]["n"] <= len(text.encode()) // 100
    assert report(df) == brute([(k % 2 or None, text) for k in range(600)], 200)


def test_cut_texts_keep_columns_of_any_names(spark):
    passage = " ".join(f"w{k}" for k in range(80))
    rows = [(1, "a " + passage, "x", 1, None), (2, passage + " b", "y", 2, [3]), (None, None, "z", 3, []), (4, "", "z", 3, [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, `a.b` int, _spans array<int>")
    found = suffix_dedup.without_repeats(docs)
    assert found.columns == docs.columns
    assert sorted((r[2], r[3], r["_spans"] or [], r["text"]) for r in found.collect() if r["text"]) == [("x", 1, [], "a "), ("y", 2, [3], " b")]
    assert sorted((r["doc_id"] or 0, r["text"]) for r in found.collect() if r["_id"] == "z") == [(0, None), (4, "")]
