"""The pipeline stage by stage against plain Python, each stage on what its predecessor kept."""

import math
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from siftwork.llm import quality_classifier, queries
from siftwork.sources.checkpoints import materialize
from test_near_duplicates import brute_rows

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TYPES = "doc_id long, text string, lang string, source string, n_chars long, score string, `a.b` int, _row int"


def plain_counts(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    text = text or ""
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    times, twice = Counter(windows), set()
    for k, x in enumerate(windows):
        if times[x] > 1:
            twice.update(range(k, k + 5))
    of = lambda chars: sum(c in chars for c in text)
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": of("#*$%&|<>"), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(twice), "n_chars": len(text), "n_lines": of("\n"), "n_upper": len(re.findall("[A-Z]", text)),
        "n_digits": len(re.findall("[0-9]", text)), "n_marks": of(".,;:?'\"()-"), "n_shouts": of("!"),
        "n_same_words": sum(a == b for a, b in zip(words, words[1:])), "n_distinct_words": len(set(words)),
        "n_long_words": sum(len(x.encode()) > 20 for x in words),
    }


def plain_score(model, text):
    found = plain_counts(text)
    ratio = lambda up, low: found[up] / found[low] if found[low] else 0.0
    value = lambda name: ratio(*quality_classifier.RATIOS[name]) if name in quality_classifier.RATIOS else float(found[name])
    holds = lambda rule: all((value(name) > at) == above for name, above, at in rule)
    return 1 / (1 + math.exp(-model.bias - sum(w for rule, w in zip(model.rules, model.weights) if holds(rule))))


def plain_cut(texts, width=200):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + width] for b in bodies for k in range(len(b) - width + 1))
    out = []
    for text, b in zip(texts, bodies):
        covered = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if seen[b[k : k + width]] > 1:
                covered[k : k + width] = b"\1" * width
        out.append(text if text is None else bytes(c for c, gone in zip(b, covered) if not gone).decode("utf-8", "ignore"))
    return out


def plain_targets(sizes):
    """Target by source: weights 3, 1, 2 repeating, 150 % of all sizes, at most twice the source's size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, target, open_ones = 1.5 * sum(sizes.values()), {}, set(order)
    while open_ones:
        share = left / sum(weight[s] for s in open_ones)
        full = {s for s in open_ones if share * weight[s] > 2 * sizes[s]}
        if not full:
            return target | {s: share * weight[s] for s in open_ones}
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
        open_ones -= full
    return target


def plain_bins(lengths, most=2048):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=room.__getitem__)] -= n
        else:
            room.append(most - n)
    return len(room)


@pytest.fixture(scope="module")
def steps(spark):
    """The rows before the first stage and after each."""
    docs, out = queries.table(spark, FOLDER, "documents"), []
    out.append(docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, FOLDER), name)
        out.append(docs.collect())
    return out


def test_classifier_stage(spark, steps):
    model = quality_classifier.train(queries.table(spark, FOLDER, "documents"), queries.table(spark, FOLDER, "labels"))
    assert model.rules and sorted(steps[1]) == sorted(r for r in steps[0] if plain_score(model, r["text"]) >= queries.ACCEPT)


def test_near_duplicate_stage(steps):
    _, components = brute_rows([(r["doc_id"], r["text"]) for r in steps[1]])
    assert sorted(r["doc_id"] for r in steps[2]) == sorted(least for least, _ in components) and len(components) < len(steps[1])
    assert set(steps[2]) <= set(steps[1])


def test_suffix_stage(steps):
    kept = plain_cut([r["text"] for r in steps[2]])
    expected = [(r["doc_id"], t, r["lang"], r["source"], len(t)) for r, t in zip(steps[2], kept)]
    assert sorted(map(tuple, steps[3])) == sorted(expected) and any(r["text"] != t for r, t in zip(steps[2], kept))


def test_mixture_stage(steps):
    size = lambda r: len(WORD.findall(r["text"] or ""))
    total, taken, longest, times = defaultdict(int), defaultdict(int), defaultdict(int), Counter(steps[4])
    for r in steps[3]:
        total[r["source"]] += size(r)
        longest[r["source"]] = max(longest[r["source"]], size(r))
    for r in steps[4]:
        taken[r["source"]] += size(r)
    assert set(times) <= set(steps[3]) and max(times.values()) <= 2
    for source, target in plain_targets(dict(total)).items():
        assert abs(taken[source] - target) <= longest[source] / 2 + 1


def test_packing_stage(steps):
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    tokenizer.encode_special_tokens = True
    expected = []
    for r in steps[4]:
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        edges = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for piece, (a, b) in enumerate(zip(edges, edges[1:])):
            expected.append((r["doc_id"], piece, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))))
    assert sorted(tuple(r)[:5] for r in steps[5]) == sorted(expected)
    bins = defaultdict(list)
    for r in steps[5]:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        ends = [0]
        for offset, length in sorted(places):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 2048
    assert len(bins) == plain_bins([e[3] for e in expected])


def test_stages_keep_columns_of_any_names_and_take_empty_tables(spark):
    texts = [" ".join(f"{p}{k}" for k in range(60)) for p in "abc"]
    rows = [(k, t, "en", s, 0, f"own {k}", k, -k) for k, (t, s) in enumerate([(texts[0], "x"), (texts[0], "x"), (texts[1], None), (None, "x"), ("", "y"), (texts[2], "y")])]
    for given in (rows, []):
        docs = spark.createDataFrame(given, TYPES)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, FOLDER)
            assert after.columns == docs.columns, name
            kept = {(r["doc_id"], r["score"], r["a.b"], r["_row"]) for r in after.collect()}
            assert kept <= {(r[0], *r[5:]) for r in given}, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == len(given)
