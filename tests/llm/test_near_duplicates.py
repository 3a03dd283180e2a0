"""Word shingles, Jaccard groups and embedding groups against brute force."""

import random
import re
import tracemalloc

import numpy as np
import pytest

import corpus_pipeline
from siftwork.llm import embedding_dedup, ngram_jaccard
from siftwork.llm.batches import batches_of
from siftwork.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def leaders(nodes, edges):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def brute_groups(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    ids = sorted(sets)
    edges = [(a, b) for a in ids for b in ids if a < b and (both := len(sets[a] & sets[b])) and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both)]
    lead = leaders(ids, edges)
    return {i: (len(sets[i]), lead[i]) for i in ids}


def groups(df, **options):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.jaccard_groups(df, **options).collect()}


def noisy_family(seed, members, words=80, edits=3):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    out = []
    for _ in range(members):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def test_families_passages_and_copies(documents):
    texts = noisy_family(1, 60) + noisy_family(2, 30, edits=8) + noisy_family(3, 10, words=12, edits=1)
    passage = " ".join(f"p{k}" for k in range(40))
    rng = random.Random(5)
    texts += [passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(60)) for _ in range(50)]
    texts += [texts[0]] * 5 + [texts[0].upper(), texts[0].replace(" ", "\t\n ")]
    rows = list(enumerate(texts))
    assert groups(documents(*rows)) == brute_groups(rows)


def test_the_order_of_shingles_changes_nothing(documents):
    rows = list(enumerate(noisy_family(7, 40, edits=6)))
    assert groups(documents(*rows), frequent=0) == groups(documents(*rows), frequent=50) == brute_groups(rows)


def test_edges_of_the_input(spark, documents):
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "ONE  two"), (5, "two one"), (6, "a b c d e"), (7, "a b c d e"), (8, "é É"), (9, "é é")]
    assert groups(documents(*rows)) == brute_groups(rows)
    nulls = ngram_jaccard.jaccard_groups(documents((None, "a b"), (1, "a b"))).collect()
    assert sorted((r["doc_id"] is None, r["component_id"]) for r in nulls) == [(False, 1), (True, None)]
    assert ngram_jaccard.jaccard_groups(documents()).count() == 0
    clashing = documents((1, "a b c"), (2, "a b c")).withColumnsRenamed({"lang": "tokens", "source": "rep", "n_chars": "component"})
    assert groups(clashing) == {1: (1, 1), 2: (1, 1)}


def test_a_long_text_and_repeated_rows(documents):
    long = " ".join(f"v{k % 70000}" for k in range(300000))
    rows = [(1, long), (2, long + " end"), (2, long + " end"), (3, "short")]
    found = ngram_jaccard.jaccard_groups(documents(*rows)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == [(1, 1), (2, 1), (2, 1), (3, 3)]


def test_far_pairs_go_before_sets_are_read(documents, monkeypatch):
    """Texts that share a passage meet, but only those that can be similar are read again; no list outlives its use."""
    rng = random.Random(3)
    texts = [" ".join(f"p{k // 2}-{i}" for i in range(24)) + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(80)) for k in range(40)]
    rows, written = list(enumerate([*texts, texts[0] + " end"])), {}
    real = ngram_jaccard.materialize
    monkeypatch.setattr(ngram_jaccard, "materialize", lambda df, name: written.setdefault(name, []).append(real(df, name)) or written[name][-1])
    dropped = []
    discard = ngram_jaccard.discard
    counts = {}

    def counted(*tables):
        for name, made in written.items():
            counts.update({(name, k): table.count() for k, table in enumerate(made) if name in ("ids", "pairs") and any(table is x for x in tables)})
            dropped.extend(name for table in made if any(table is x for x in tables))
        discard(*tables)

    monkeypatch.setattr(ngram_jaccard, "discard", counted)
    assert groups(documents(*rows)) == brute_groups(rows)
    assert sum(n for (name, _), n in counts.items() if name == "pairs") > 10
    assert sum(n for (name, _), n in counts.items() if name == "ids") == 2
    assert "prefixes" in dropped and "tokens" not in written["rows"][0].columns


def test_shingles_are_counted_in_little_room():
    rng = np.random.default_rng(3)
    pieces = [rng.integers(0, 1 << 32, 50_000, dtype=np.uint64).astype(np.uint32) for _ in range(20)]
    pieces += [pieces[0], np.zeros(7, np.uint32), np.full(5, (1 << 32) - 1, np.uint32), np.zeros(0, np.uint32)]
    tokens, counts = np.unique(np.concatenate(pieces), return_counts=True)
    size, held = sum(x.nbytes for x in pieces), [x.copy() for x in pieces]
    pairs = [(x.astype(np.uint64) << np.uint64(32)) | np.uint64(3) for x in pieces]
    for count, parts, times, most in ((ngram_jaccard._counted, held, 1, 5), (ngram_jaccard._totals, pairs, 3, 9)):
        tracemalloc.start()
        found = count(parts)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert np.array_equal(found[0], tokens) and np.array_equal(found[1], times * counts) and not parts
        assert peak < most * size  # np.unique and a stable argsort took 14 and 10 times as much
    for n in (1, 12, 211):
        starts = ngram_jaccard._range_starts(n)
        dealt = np.diff([*np.searchsorted(tokens, starts), len(tokens)])
        assert len(starts) == n and dealt.sum() == len(tokens) and dealt.max() < 1.2 * len(tokens) / n
    assert [len(x) for x in ngram_jaccard._counted([np.zeros(0, np.uint32)])] == [0, 0]


def test_batches_are_short_only_inside(spark):
    keys = ["spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch"]
    before = [spark.conf.get(key) for key in keys]
    with pytest.raises(KeyError), batches_of(spark, 2048):
        assert [spark.conf.get(key) for key in keys] == ["512", "4m", "2048"]
        with batches_of(spark, 100):
            assert [spark.conf.get(key) for key in keys] == ["512", "4m", "100"]
        raise KeyError
    assert [spark.conf.get(key) for key in keys] == before


def test_lists_of_copies_go_once(spark):
    worded = spark.createDataFrame([(k, 2, [k, k + 1]) for k in range(300)], "doc long, n long, tokens array<long>")
    for step in (1, 7, 301):
        heads = spark.range(0, 300, step).withColumnRenamed("id", "doc")
        assert sorted(r["tokens"][0] for r in ngram_jaccard._lists_of(worded, heads).collect()) == list(range(0, 300, step))


@pytest.mark.parametrize("sizes", [(5, 6), (200, 250), (60, 70), (3000, 4000), (500, 500)])
def test_parities_never_exceed_the_difference(sizes):
    rng = np.random.default_rng(sum(sizes))
    for shared in (0, min(sizes) // 2, min(sizes)):
        common = rng.integers(0, 1 << 63, shared, np.uint64)
        sets = [np.unique(np.concatenate((common, rng.integers(0, 1 << 63, n - shared, np.uint64)))) for n in sizes]
        n = np.array([len(x) for x in sets])
        x, y = (b.as_py() for b in ngram_jaccard._parities(np.concatenate(sets), np.repeat([0, 1], n), n))
        apart = len(np.setxor1d(*sets))
        assert ngram_jaccard._differing(x, y) <= apart and (ngram_jaccard._differing(x, y) * 7 > n.sum()) >= (shared == 0)


def brute_rows(rows):
    """Per row: count of shingles, the component's smallest id, and whether the row leads its component."""
    sets = [shingle_set(r[1]) for r in rows]
    edges = [(a, b) for a in range(len(rows)) for b in range(a) if (both := len(sets[a] & sets[b])) and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both)]
    lead, members = leaders(range(len(rows)), edges), {}
    for k in range(len(rows)):
        members.setdefault(lead[k], []).append(k)
    ids = {c: [rows[k][0] for k in m if rows[k][0] is not None] for c, m in members.items()}
    return [(r[0], len(sets[k]), None if r[0] is None else min(ids[lead[k]])) for k, r in enumerate(rows)], [(min(ids[c], default=None), [rows[k] for k in m]) for c, m in members.items()]


def test_rows_that_share_an_id_or_have_none(spark, documents):
    base, other, third, lone = (" ".join(f"{p}{k}" for k in range(40)) for p in "abcd")
    rows = [
        (3, base), (7, other), (7, base + " tail"), (7, base), (5, third), (5, third), (5, third + " end"), (5, third, "t"), (None, third), (9, None), (9, None), (9, " "),
        (None, lone), (None, lone), (None, lone + " x"), (None, ""), (8, other + " y"), (11, "p q"), (11, "p q"), (11, "r s"), (12, "r  S"),
    ]
    expected, components = brute_rows(rows)
    found = ngram_jaccard.jaccard_groups(documents(*rows)).collect()
    show = lambda x: sorted(map(repr, x))
    assert show((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == show(expected)
    stage = dict(corpus_pipeline.STAGES)["ngram_jaccard_join"](spark, documents(*rows), "")
    left = [(r["doc_id"], r["text"]) for r in stage.collect()]
    for first, members in components:
        of_group = [r for r in left if r in {m[:2] for m in members}]
        assert len(of_group) == (left.count(of_group[0]) if not shingle_set(members[0][1]) else 1) and of_group[0][0] == first
    assert len(left) == len(components) and stage.columns == documents().columns


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)] + [(200, k) for k in range(201, 260)] + [(7, 7), (None, 3)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert found == leaders({n for e in real for n in e}, real)


VECTORS = "vec_id long, embedding array<float>, label int"


def brute_vectors(rows, cosine=0.9):
    x = {i: np.array(v, float) for i, v in rows}
    edges = [(a, b) for a in x for b in x if a < b and len(x[a]) == len(x[b]) and x[a] @ x[b] / np.sqrt((x[a] @ x[a]) * (x[b] @ x[b])) >= cosine]
    lead = leaders(x, edges)
    return {i: (sum(i in e for e in edges), lead[i], lead[i] == i) for i in x}


def vectors(spark, rows, **options):
    found = embedding_dedup.near_duplicates(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS), **options)
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found.collect()}


@pytest.mark.parametrize("block", [1024, 8])
def test_vectors(spark, block):
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((12, 24))
    x = [np.float32(c + rng.standard_normal(24) * 0.25).tolist() for c in centers for _ in range(8)] + [np.float32(centers[0] * k).tolist() for k in (1, 2, 2, 2)]
    rows = list(enumerate(x))
    assert vectors(spark, rows, block=block) == brute_vectors(rows)


def test_odd_vectors_link_with_nothing(spark):
    odd = [None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0]]
    rows = [(k, v) for k, v in enumerate(odd)] + [(10, [1.0, 0.0]), (11, [2.0, 0.0]), (12, [1.0, 0.0, 0.0])]
    found = vectors(spark, rows)
    assert all(found[k] == (0, k, True) for k in range(len(odd))) and found[10] == (1, 10, True) and found[11] == (1, 10, False) and found[12] == (0, 12, True)
    assert vectors(spark, []) == {} and vectors(spark, [(None, [1.0]), (1, [1.0])])[None] == (0, None, False)
