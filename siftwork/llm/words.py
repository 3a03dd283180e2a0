"""Words and shingles of many texts at once, as numpy arrays over the texts' bytes.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
_BASE = 0x9E3779B97F4A7C15
_STEP = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(32)
    return x


_TABLES: dict[int, np.ndarray] = {}
_SPAN = 1 << 19


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1); the longest table so far is kept, at most that of `_SPAN` bytes or one longer word."""
    table = _TABLES.get(base)
    if table is None or len(table) < n:
        table = np.full(max(1 << 16, 1 << (max(n, 1) - 1).bit_length()), base, np.uint64)
        table[0] = 1
        _TABLES[base] = np.multiply.accumulate(table)
        table = _TABLES[base]
    return table[:n]


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The rows again, in slices of about `limit` text bytes; a longer text comes alone."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes.astype(np.int64)) // limit
        edges = np.flatnonzero(np.diff(group)) + 1
        for start, end in zip([0, *edges], [*edges, len(sizes)]):
            if end > start:
                yield batch.slice(start, end - start)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: none) and where each text begins; one more offset ends them."""
    plain = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + len(plain) + 1]
    body = plain.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word."""
    inside = (data != 32) & ~((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
    starts = np.flatnonzero(inside & ~before)
    after = np.concatenate((inside[1:], [False])) & ~edge[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of every word, by its bytes alone; computed over spans of words, so that long texts need little room."""
    if len(data) <= _SPAN:
        return _span_hashes(data, starts, ends)
    cuts = np.flatnonzero(np.diff(starts // (_SPAN // 2))) + 1
    bounds = [0, *cuts.tolist(), len(starts)]
    parts = [
        _span_hashes(data[starts[i] : ends[j - 1]], starts[i:j] - starts[i], ends[i:j] - starts[i]) for i, j in zip(bounds, bounds[1:]) if j > i
    ]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=sums[1:])
    back = powers(pow(_BASE, -1, 1 << 64), n)
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def folded(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of every run of `width` consecutive words."""
    n = max(0, len(words) - width + 1)
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = out * np.uint64(_STEP) + words[k : k + n]
    return mix(out)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct shingles of every text, sorted by both.

    A text of fewer than `width` words has its whole sequence as one shingle, one without words none.
    """
    data = folded(data)
    starts, ends, text = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends)
    runs = window_hashes(words, width)
    whole = text[: len(runs)] == text[width - 1 :][: len(runs)]
    owner, hashes = [text[: len(runs)][whole]], [runs[whole]]
    counts = np.bincount(text, minlength=len(offsets) - 1)
    first = np.cumsum(counts) - counts
    for k in range(1, width):
        short = np.flatnonzero(counts == k)
        if len(short):
            owner.append(short)
            hashes.append(window_hashes(words, k)[first[short]])
    owner, hashes = np.concatenate(owner), np.concatenate(hashes)
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return owner[fresh], hashes[fresh]


def ragged(values: np.ndarray, owner: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """A list column of `n` rows from values sorted by their row."""
    bounds = np.searchsorted(owner, np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))
