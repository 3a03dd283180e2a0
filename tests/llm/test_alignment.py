"""Token links and groups against token-by-token loops."""

import hashlib
import random
from collections import Counter

import public_tokenizers as P
import sentencepiece
from tokenizers import Tokenizer

from siftwork.llm import alignment, queries

A, B = str(P.path("byte_bpe_50k.json")), str(P.path("piece_bpe_32k.model"))
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def printable():
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    out, extra = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            out[chr(256 + extra)] = b
            extra += 1
    return out


def brute(rows):
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    byte_of, second = printable(), sentencepiece.SentencePieceProcessor(model_file=B)
    found, total = [], Counter()
    for _, text in rows:
        tokens = []
        for side in "ab":
            at, own = 0, []
            ids = first.encode(" " + (text or ""), add_special_tokens=False).ids if side == "a" else second.encode(text or "")
            body = b""
            for k in ids:
                piece = first.id_to_token(k) if side == "a" else second.id_to_piece(k)
                raw = bytes(byte_of[c] for c in piece) if side == "a" else bytes([int(piece[3:5], 16)]) if second.is_byte(k) else piece.replace("▁", " ").encode()
                own.append((k, at, at + len(raw)))
                at, body = at + len(raw), body + raw
            tokens.append((own, body))
        if not text or any(body != (" " + text).encode() for _, body in tokens):
            found.append(None)
            continue
        a, b = tokens[0][0], tokens[1][0]
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        shared = sorted({x[2] for x in a} & {y[2] for y in b})
        parts, low = [], 0
        for high in shared:
            parts.append("|".join(",".join(str(x[0]) for x in side if low < x[2] <= high) for side in (a, b)))
            low = high
        total.update(links)
        found.append((len(a), len(b), len(shared), links, hashlib.sha256(";".join(parts).encode()).hexdigest()))
    most = Counter()
    for (a, b), n in total.items():
        most[b] = max(most[b], n)
    out = []
    for (i, _), f in zip(rows, found):
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((i, *f[:3], len(f[3]), sum(total[p] == most[p[1]] for p in f[3]), sum(total[p] for p in f[3]), f[4]))
    return out, total


def prose(n):
    random.seed(n)
    words = ["data", "Überraschung", "的", "naïve", "tokenizer", "42,000", "don't", "日本語", "foo_bar", "\n\n", "  ", "é", "🙂", "the", "of"]
    return [" ".join(random.choices(words, k=random.randint(1, 40))) for _ in range(n)]


ODD = [None, "", " ", "   ", "a", "▁d", "x ▁", "<|endoftext|>", "<s> </s> <unk>", "<0x41>", "\t\r\n", "é", "🙂🙂", "\x00z", " lead", "trail ", "a" * 3000, "́", "한국어 텍스트", "ﬁ ½ Ⅳ"]


def rows_of(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.select(*NAMES).collect()), key=lambda r: (r[0] is None, *r))


def test_alignment_equals_loops(spark, documents):
    rows = list(enumerate(ODD + prose(60) + ["the same text"] * 3))
    expected, total = brute(rows)
    docs = documents(*rows).repartition(5)
    assert rows_of(alignment.align_tokenizers(docs, A, B)) == sorted(expected)
    assert {(r["a"], r["b"]): r["n"] for r in alignment.pair_counts(docs, A, B).collect()} == total


def test_small_slices_and_blocks_change_nothing(spark, documents, monkeypatch):
    rows = list(enumerate(ODD + prose(40)))
    monkeypatch.setattr(alignment, "SLICE", 64)
    monkeypatch.setattr(alignment, "_BLOCK_BYTES", 300)
    monkeypatch.setattr(alignment, "_BLOCK", 7)
    assert rows_of(alignment.align_tokenizers(documents(*rows).coalesce(2), A, B)) == sorted(brute(rows)[0])


def test_long_texts(spark, documents):
    rows = [(1, "word " * 60_000), (2, "x" * 200_000), (3, " " * 2_000_000 + "end"), (4, "\n" * 300_000)]
    for row in alignment.align_tokenizers(documents(*rows), A, B).collect():
        assert row["n_links"] == row["n_a"] + row["n_b"] - row["n_groups"] > 0 and len(row["groups_sha256"]) == 64


def test_ids_may_repeat_or_be_null_and_names_may_clash(spark):
    rows = [(7, "one text"), (7, "one text"), (7, "other text"), (None, "third"), (None, None)]
    clashing = spark.createDataFrame([(i, t, 1, "x", 2.0) for i, t in rows], "doc_id long, text string, block int, pair string, n_a double")
    expected = brute(rows)[0]
    assert rows_of(alignment.align_tokenizers(clashing, A, B)) == sorted(expected, key=lambda r: (r[0] is None, *r))


def test_empty_table_and_only_empty_texts(spark, documents):
    assert rows_of(alignment.align_tokenizers(documents((1, "x")).limit(0), A, B)) == []
    assert rows_of(alignment.align_tokenizers(documents((1, None), (2, "")), A, B)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_query_equals_loops_on_whole_documents(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in queries.table(spark, folder, "documents").collect()]
    rows = [r for r in rows if len(r[1] or "") < 3000]  # the loops compare all pairs of tokens
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(alignment.align_tokenizers(docs, A, B)) == sorted(brute(rows)[0])
    whole = queries.op11_tokenizer_alignment(spark, folder)
    assert whole.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert whole.count() == queries.table(spark, folder, "documents").count()
