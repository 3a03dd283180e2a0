"""Best-fit packing: documents into as few sequences of a fixed length as can be found.

Best-fit decreasing over all pieces at once. What the algorithm does depends on lengths alone, and
there are no more lengths than tokens in a sequence, so it runs on the corpus-wide counts by length:
pieces of one length go into bins in runs, each run found by a segment tree over remaining
capacities. Spark counts lengths, orders pieces by length and hands each the place its run gives.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siftwork.llm import words as w
from siftwork.llm.batches import batches_of
from siftwork.llm.names import col, free, numbered, without
from siftwork.llm.order import with_place
from siftwork.sources.checkpoints import materialize

#: The pattern of the faster library runs out of stack on a million blanks in a row.
_MANY_BLANKS = re.compile(r"\s{100000}")

Encoder = Callable[[str], list[int]]
_ENCODERS: dict[str, Encoder] = {}


def suits_fast(text: str) -> bool:
    """Whether `tiktoken` can cut this text into words."""
    return len(text) < 100_000 or not _MANY_BLANKS.search(text)


def _plain_tokenizer(json_path: str) -> Encoder:
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)
    return lambda text: slow.encode(text, add_special_tokens=False).ids


def byte_bpe(json_path: str) -> Encoder:
    """The ids that `tokenizers` gives for this file without adding special tokens.

    Where the vocabulary also lies beside it as ranks, the faster library reads those: the ids are
    the same, and the text of the special token becomes its id in both.
    """
    if json_path not in _ENCODERS:
        slow = lru_cache(maxsize=1)(lambda: _plain_tokenizer(json_path))
        ranks_path = json_path.removesuffix(".json") + ".tiktoken"
        try:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            special = {"<|endoftext|>": len(ranks)}
            fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
            _ENCODERS[json_path] = lambda text: fast.encode(text, allowed_special="all") if suits_fast(text) else slow()(text)
        except (ImportError, FileNotFoundError):
            _ENCODERS[json_path] = slow()
    return _ENCODERS[json_path]


class CapacityTree:
    """Segment tree over remaining capacities: the tightest capacity of at least n that some open bin has."""

    def __init__(self, most: int) -> None:
        self._size = 1 << most.bit_length()
        self._count = [0] * (2 * self._size)

    def add(self, capacity: int, n: int) -> None:
        node = capacity + self._size
        while node:
            self._count[node] += n
            node //= 2

    def tightest(self, least: int) -> int | None:
        node = least + self._size
        if self._count[node]:
            return least
        while node > 1:  # up to the first right neighbour with open bins, then down its left edge
            if node % 2 == 0 and self._count[node + 1]:
                node += 1
                while node < self._size:
                    node = 2 * node if self._count[2 * node] else 2 * node + 1
                return node - self._size
            node //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first, per_bin, bin, offset): pieces of a length from the `first`-th on go `per_bin` to a bin.

    `bin` is the run's first bin and `offset` the fill of its bins before. Same bins as placing
    pieces one by one, longest first, each into the open bin with the least room that takes it.
    """
    tree = CapacityTree(capacity)
    open_bins: dict[int, deque[tuple[int, int]]] = {}  # remaining capacity -> (first bin, bins)
    runs, opened = [], 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            open_bins.setdefault(room, deque()).append((first, n))
            tree.add(room, n)

    for length in sorted(counts, reverse=True):
        left, placed = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, each = capacity, capacity // length
                first, n = opened, -(-left // each)
                opened += n
            else:
                each = room // length
                first, n = open_bins[room].popleft()
                tree.add(room, -n)
            full = min(n, left // each)
            if full:
                runs.append((length, placed, each, first, capacity - room))
                put(room - each * length, first, full)
                placed, left = placed + full * each, left - full * each
            rest = n - full
            if rest and left and left < each:
                runs.append((length, placed, each, first + full, capacity - room))
                put(room - left * length, first + full, 1)
                placed, left, full, rest = placed + left, 0, full + 1, rest - 1
            if rest:
                put(room, first + full, rest)
    return runs


def cut_lengths(n: int, most: int) -> list[int]:
    """Lengths of the pieces of a document: all but the first are full."""
    head = n % most
    return ([head] if head else []) + [most] * (n // most)


def token_pieces(docs: DataFrame, tokenizer: str, most: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document of `docs(doc_id, text)`.

    A document is the ids of its whole text (null: empty) and `end_id`; only documents of more than
    `most` ids are cut.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(tokenizer)
        for rows in w.chunks(batches, "text"):
            out: list[list] = [[], [], [], [], [], []]
            for k, text in enumerate(rows.column(1).to_pylist()):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                start = 0
                for piece, n in enumerate(cut_lengths(len(ids), most)):
                    part = ids[start : start + n]
                    for column, value in zip(out, (k, piece, start, n, zlib.crc32(part.tobytes()), part.astype(np.int32) if with_ids else None)):
                        column.append(value)
                    start += n
            take = pa.array(out[0], pa.int64())
            columns = [rows.column(0).take(take), pa.array(out[1], pa.int32()), *[pa.array(c, pa.int64()) for c in out[2:5]]]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(out[5], pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack(pieces: DataFrame, most: int = 2048) -> DataFrame:
    """The rows of `pieces(length, ...)`, a written table, with sequence_id and offset.

    Lengths from 1 to `most`. Equal rows take places of their own. Only counts by length (at most
    `most` rows) and the runs made of them are gathered. An empty table gives none. Columns may have any
    names; those named sequence_id or offset, in any case, give way.
    """
    pieces = pieces.select(*map(col, without(pieces.columns, ["sequence_id", "offset"])))
    counts = {row["length"]: row["count"] for row in pieces.groupBy("length").count().collect()}
    runs = best_fit_decreasing(counts, most)
    table = {}
    for length in counts:
        of = [r for r in runs if r[0] == length]
        table[length] = tuple(np.array([r[k] for r in of], np.int64) for k in range(1, 5))
    before, start = 0, {}
    for length in sorted(counts):
        start[length] = before
        before += counts[length]
    shared = pieces.sparkSession.sparkContext.broadcast((table, start))
    columns, place_name = pieces.columns, free("_place", pieces.columns)
    length_at, kinds = columns.index("length"), [*[f.dataType for f in pieces.schema], T.LongType(), T.LongType()]
    schema = T.StructType([T.StructField(f"c{k}", kind) for k, kind in enumerate(kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, first_place = shared.value
        for rows in batches:
            length = rows.column(length_at).to_numpy()
            place = rows.column(len(columns)).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                k = np.flatnonzero(length == n)
                firsts, each, bins, fill = known[n]
                rank = place[k] - first_place[n]
                r = np.searchsorted(firsts, rank, "right") - 1
                inside = rank - firsts[r]
                sequence[k] = bins[r] + inside // each[r]
                offset[k] = fill[r] + inside % each[r] * n
            kept = [rows.column(k) for k in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], schema.names)

    others = [col(c) for c in columns if c != "length" and pieces.schema[c].dataType.typeName() not in ("array", "map", "struct")]
    placed = with_place(pieces, "length", *others, name=place_name)
    return numbered(placed).mapInArrow(run, schema).toDF(*columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, most: int = 2048, with_ids: bool = False) -> DataFrame:
    """Every piece of `docs(doc_id, text)` with its place in a sequence; no other column is read."""
    with batches_of(docs.sparkSession, 2048):
        pieces = materialize(token_pieces(docs, tokenizer, most, with_ids=with_ids), "pieces")
    return pack(pieces, most)
