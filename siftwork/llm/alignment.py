"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often.

Arrow all the way. Token lists are flattened beside the index of their document, byte lengths are
summed up segment by segment, and the two sides meet in a hash join on (document, end): a document's
offset in its batch plus the end of the token. An end that both sides have closes a group. Every stretch
between two ends belongs to one token of each side, so it is one link: after the join, the ids missing
in a row are those of the next row that has one.

Links of a block of documents are counted by `Table.group_by`, Spark adds the counts of all blocks up, and
each block gets the counts of its own distinct pairs back. Links themselves are never shuffled by pair.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm import words as w
from siftwork.llm.batches import batches_of
from siftwork.llm.packing import suits_fast
from siftwork.sources.checkpoints import materialize

SLICE = 1 << 20  # text bytes aligned at once; a longer text comes alone
_BLOCK = 4096  # documents whose links are counted together, fewer where texts are long
_BLOCK_BYTES = 1 << 23
_SIDE = 1 << 32  # a pair of ids as one number: A * _SIDE + B


def _byte_level() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteBpe:
    """Side A: ids and token bytes of a byte-level file for `tokenizers`, special tokens read as plain text."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self._slow = Tokenizer.from_file(path)
        self._slow.encode_special_tokens = True
        byte_of = _byte_level()
        entries = self._slow.get_vocab(with_added_tokens=True)
        table = [b""] * (max(entries.values()) + 1)
        for entry, k in entries.items():
            table[k] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
        self.table = table
        self._fast = self._ranks(path.removesuffix(".json") + ".tiktoken")

    @staticmethod
    def _ranks(path: str):
        """The faster library, where the same vocabulary lies beside the file as ranks."""
        try:
            import public_tokenizers
            import tiktoken

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            return tiktoken.Encoding("side_a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        except (ImportError, FileNotFoundError):
            return None

    def encode(self, texts: list[str]) -> list[list[int]]:
        spaced = [" " + t for t in texts]
        if self._fast is None:
            return [self._slow.encode(t, add_special_tokens=False).ids for t in spaced]
        return [self._fast.encode_ordinary(t) if suits_fast(t) else self._slow.encode(t, add_special_tokens=False).ids for t in spaced]


class PieceBpe:
    """Side B: ids and token bytes of a `sentencepiece` model, which puts the leading space itself."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self._model = SentencePieceProcessor(model_file=path)
        ids = range(self._model.get_piece_size())
        self.table = [bytes([int(p[3:5], 16)]) if self._model.is_byte(k) else p.replace("▁", " ").encode() for k, p in zip(ids, map(self._model.id_to_piece, ids))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


@dataclass(frozen=True)
class _Side:
    encoder: ByteBpe | PieceBpe
    bytes: pa.BinaryArray
    lengths: np.ndarray


@lru_cache(maxsize=4)
def _side(kind: str, path: str) -> _Side:
    encoder = ByteBpe(path) if kind == "A" else PieceBpe(path)
    table = pa.array(encoder.table, pa.large_binary())
    return _Side(encoder, table, pc.binary_length(table).to_numpy().astype(np.int64))


@lru_cache(maxsize=1)
def _labels(n: int) -> pa.LargeBinaryArray:
    """Decimal ids followed by `,`, `|` and `;` in turn: 3 * id + (0, 1, 2)."""
    return pa.array([f"{k}{mark}".encode() for k in range(n) for mark in ",|;"], pa.large_binary())


def _bytes_of(texts: pa.LargeBinaryArray) -> np.ndarray:
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)


def _lists(ids: list[list[int]]) -> pa.LargeListArray:
    return pa.array(ids, pa.large_list(pa.int32()))


def _sums(values: np.ndarray, parent: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(parent, values, n).astype(np.int64) if len(values) else np.zeros(n, np.int64)


def _whole(lists: pa.LargeListArray, side: _Side, texts: pa.LargeBinaryArray) -> np.ndarray:
    """Which documents' joined token bytes are their text."""
    n = len(texts)
    flat, parent = lists.flatten().to_numpy(), pc.list_parent_indices(lists).to_numpy()
    size = pc.binary_length(texts).to_numpy()
    same = _sums(side.lengths[flat], parent, n) == size
    kept = pa.array(same)
    own = lists.filter(kept).flatten()
    equal = _bytes_of(side.bytes.take(own)) == _bytes_of(pa.concat_arrays([texts.filter(kept)]))
    owner = np.repeat(np.flatnonzero(same), size[same])
    same[np.unique(owner[~equal])] = False
    return same


def align(texts: list[str], a: _Side, b: _Side) -> tuple[dict[str, np.ndarray], list[str], np.ndarray, np.ndarray]:
    """Per text n_a, n_b, n_groups, n_links; the digest of its groups; and the links, (A, B) as one number, with their text.

    Texts that are empty or not the joined bytes of both sides have zeros and an empty digest.
    """
    n = len(texts)
    lists = [_lists(a.encoder.encode(texts)), _lists(b.encoder.encode(texts))]
    # as binary from here on: (" " + text) in UTF-8
    spaced = pa.array([(" " + t).encode() for t in texts], pa.large_binary())
    there = np.array([bool(t) for t in texts], bool) & _whole(lists[0], a, spaced) & _whole(lists[1], b, spaced)
    documents = np.flatnonzero(there)
    sides, counts = [], []
    for tokens, side, name in zip(lists, (a, b), "ab"):
        kept = tokens.filter(pa.array(there))
        flat, parent = kept.flatten(), documents[pc.list_parent_indices(kept).to_numpy()]
        # kept documents have as many bytes on both sides, so one running sum is (document, end)
        end = np.cumsum(side.lengths[flat.to_numpy()])
        sides.append(pa.table({"end": end, name: flat, f"doc_{name}": parent}))
        counts.append(np.bincount(parent, minlength=n).astype(np.int64))
    joined = sides[0].join(sides[1], "end", join_type="full outer", use_threads=False).sort_by("end")
    both = pc.and_(joined["a"].is_valid(), joined["b"].is_valid()).to_numpy()
    doc = pc.coalesce(joined["doc_a"], joined["doc_b"]).to_numpy()
    links = pc.add(pc.multiply(pc.fill_null_backward(joined["a"]).cast(pa.int64()), _SIDE), pc.fill_null_backward(joined["b"]).cast(pa.int64())).to_numpy()
    found = {"n_a": counts[0], "n_b": counts[1], "n_groups": np.bincount(doc[both], minlength=n).astype(np.int64), "n_links": np.bincount(doc, minlength=n).astype(np.int64)}
    return found, _digests(sides, joined["end"].to_numpy()[both], documents, counts, n, max(len(a.lengths), len(b.lengths))), links, doc


def _digests(sides: list[pa.Table], shared: np.ndarray, documents: np.ndarray, counts: list[np.ndarray], n: int, most: int) -> list[str]:
    """SHA-256 of `a1,a2|b1;a3|b2,b3`: A's tokens of a group, then B's, group by group."""
    group = [np.searchsorted(shared, t["end"].to_numpy()) for t in sides]
    last = [np.isin(t["end"].to_numpy(), shared, assume_unique=True) for t in sides]
    size = [np.bincount(g, minlength=len(shared)) for g in group]
    before = [np.cumsum(s) for s in size]
    at_a = np.arange(len(group[0])) + (before[1] - size[1])[group[0]]
    at_b = np.arange(len(group[1])) + before[0][group[1]]
    codes = np.empty(len(at_a) + len(at_b), np.int64)
    codes[at_a] = 3 * sides[0]["a"].to_numpy().astype(np.int64) + last[0]
    codes[at_b] = 3 * sides[1]["b"].to_numpy().astype(np.int64) + 2 * last[1]
    out, start = [""] * n, 0
    labels = _labels(most).take(pa.array(codes))
    offsets = np.frombuffer(labels.buffers()[1], np.int64)
    body = memoryview(labels.buffers()[2]) if len(codes) else memoryview(b"")
    for k in documents.tolist():
        stop = start + int(counts[0][k] + counts[1][k])
        out[k] = hashlib.sha256(body[offsets[start] : offsets[stop] - 1]).hexdigest()  # without the last mark
        start = stop
    return out


def _aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document, its links as places in the block's list of pairs, and per block (doc_id null) that list with counts."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from w.chunks(iter([batch]), "text", _BLOCK_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _side("A", path_a), _side("B", path_b)
        block = TaskContext.get().partitionId() << 32
        for rows in blocks(batches):
            found: dict[str, list] = {"n_a": [], "n_b": [], "n_groups": [], "n_links": []}
            digests, links, start = [], [], 0
            for part in w.chunks(iter([rows]), "text", SLICE):
                numbers, own, pairs, _ = align([t or "" for t in part.column(1).to_pylist()], a, b)
                for name, values in numbers.items():
                    found[name].append(values)
                digests += own
                links.append(pairs)
            coded = pa.array(np.concatenate(links)).dictionary_encode()
            counted = pa.table({"at": coded.indices}).group_by("at", use_threads=False).aggregate([("at", "count")]).sort_by([("at_count", "descending"), ("at", "ascending")])
            place = np.empty(len(counted), np.int32)  # frequent pairs first: small numbers shrink
            place[counted["at"].to_numpy()] = np.arange(len(counted), dtype=np.int32)
            columns = {name: np.concatenate(values) for name, values in found.items()}
            ends = np.concatenate(([0], np.cumsum(columns["n_links"]))).astype(np.int32)
            used = pa.ListArray.from_arrays(pa.array(ends), pa.array(place[coded.indices.to_numpy()] if len(place) else np.zeros(0, np.int32)))
            size = len(rows)
            nothing = pa.nulls(size, pa.list_(pa.int64()))
            names = ["block", "doc_id", "groups_sha256", *columns, "links", "pairs", "counts"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, block)), rows.column(0), pa.array(digests, pa.string()), *[pa.array(c) for c in columns.values()], used, nothing, nothing], names
            )
            if len(counted):
                pairs = coded.dictionary.take(counted["at"].combine_chunks())
                one = [pa.array([0, len(counted)], pa.int32())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block]), pa.nulls(1, rows.schema.field(0).type), pa.nulls(1, pa.string()), *[pa.array([0])] * 4, pa.nulls(1, pa.list_(pa.int32())),
                        pa.ListArray.from_arrays(one[0], pairs), pa.ListArray.from_arrays(one[0], counted["at_count"].combine_chunks()),
                    ],
                    names,
                )
            block += 1

    schema = f"block long, doc_id {kind}, groups_sha256 string, n_a long, n_b long, n_groups long, n_links long, links array<int>, pairs array<long>, counts array<long>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pair_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(a, b, n): how many links of all documents hold the pair of ids."""
    with batches_of(docs.sparkSession, _BLOCK):
        table = materialize(_aligned(docs, path_a, path_b), "aligned")
    return _totals(_partial(table)).select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(_SIDE - 1).cast("int").alias("b"), "n")


def _partial(table: DataFrame) -> DataFrame:
    """(block, at, pair, c): the pairs of every block and their counts in it."""
    lists = table.filter("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("at", "one"))
    return lists.select("block", "at", F.col("one.pairs").alias("pair"), F.col("one.counts").alias("c"))


def _totals(partial: DataFrame) -> DataFrame:
    return partial.groupBy("pair").agg(F.sum("c").alias("n"))


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per row of `docs(doc_id, text)`: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    `path_a` is a byte-level file for `tokenizers`, given a space and the text, `path_b` a `sentencepiece`
    model that adds the space. A pair's count is the number of links of all documents that hold it;
    n_best are the links whose count is the highest of their B id, ties included, count_sum is the
    sum of counts over links. Null and empty texts and those that the tokens do not spell byte for byte
    have zeros and an empty digest. doc_id may repeat or be null. Other columns are not read; an empty
    table gives none.
    """
    with batches_of(docs.sparkSession, _BLOCK):
        table = materialize(_aligned(docs, path_a, path_b), "aligned")
    partial = _partial(table)
    totals = materialize(_totals(partial).withColumn("b", F.col("pair").bitwiseAND(_SIDE - 1).cast("int")), "totals")
    highest = totals.groupBy("b").agg(F.max("n").alias("most"))  # a row per entry of B's vocabulary
    known = totals.join(F.broadcast(highest), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    answers = partial.select("block", "at", "pair").join(known, "pair").select(F.col("block").alias("of"), "at", "n", "best")
    documents = table.filter("pairs is null")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def settle(own: pa.Table, counts: pa.Table) -> pa.Table:
        at = counts["at"].to_numpy()
        n, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        n[at], best[at] = counts["n"].to_numpy(), counts["best"].to_numpy()
        lists = own["links"].combine_chunks()
        flat = lists.flatten().to_numpy()
        ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
        sums = []
        for values in (best, n):
            running = np.concatenate((np.zeros(1, np.int64), np.cumsum(values[flat] if len(flat) else np.zeros(0, np.int64))))
            sums.append(pa.array(running[ends[1:]] - running[ends[:-1]]))
        return pa.table([own["doc_id"], own["n_a"], own["n_b"], own["n_groups"], own["n_links"], *sums, own["groups_sha256"]], names)

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return documents.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(settle, schema)
