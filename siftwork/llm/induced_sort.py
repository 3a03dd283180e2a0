"""Suffix arrays by induced sorting, and permuted common prefixes, over numpy arrays.

Suffixes fall into types: smaller (S) or larger (L) than the one that starts a symbol later. The
leftmost S of each run (LMS) are few; once they are in order, a pass over the buckets of first
symbols places all L suffixes and a pass back places all S suffixes. The LMS substrings are put in
order by the same two passes, named by rank, and the string of names is sorted the same way.
A bucket is handled as a whole: its suffixes induce their predecessors in one array step.
"""

from __future__ import annotations

import numpy as np

from siftwork.llm.words import powers

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BUCKETS = 1024  # a string of names with more symbols is sorted by doubling ranks


def _types(t: np.ndarray) -> np.ndarray:
    """True for S. The last symbol is the smallest and stands alone."""
    n = len(t)
    step = np.sign(np.diff(t.astype(np.int64)))
    place = np.where(step != 0, np.arange(n - 1), n)
    nearest = np.minimum.accumulate(place[::-1])[::-1]
    smaller = np.ones(n, bool)
    smaller[:-1] = np.concatenate((step, [1]))[np.minimum(nearest, n - 1)] > 0
    return smaller


def _push(into: list[list[np.ndarray]], t: np.ndarray, rows: np.ndarray) -> None:
    if len(rows):
        symbols = t[rows]
        order = np.argsort(symbols, kind="stable")
        rows, symbols = rows[order], symbols[order]
        cuts = np.flatnonzero(np.diff(symbols)) + 1
        for part, symbol in zip(np.split(rows, cuts), symbols[np.concatenate(([0], cuts))]):
            into[symbol].append(part)


def _drain(bucket: list[np.ndarray], symbol: int, wanted: np.ndarray, into: list[list[np.ndarray]], t: np.ndarray) -> np.ndarray:
    """The bucket's suffixes in scan order; each wave's predecessors go to their buckets."""
    seen, at = [], 0
    while at < len(bucket):
        wave = np.concatenate(bucket[at:])
        at = len(bucket)
        seen.append(wave)
        before = wave[wave > 0] - 1
        _push(into, t, before[wanted[before]])
    return np.concatenate(seen) if seen else np.zeros(0, np.int64)


def _induce(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    first: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    _push(first, t, lms)
    larger: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    done = []
    for c in range(sigma):
        done.append(_drain(larger[c], c, ~smaller, larger, t))
        for rows in first[c]:
            before = rows[rows > 0] - 1
            _push(larger, t, before)
    back: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    out = [np.zeros(0, np.int64)] * (2 * sigma)
    for c in range(sigma - 1, -1, -1):
        tail = _drain(back[c], c, smaller, back, t)
        out[2 * c], out[2 * c + 1] = done[c], tail[::-1]
        rows = done[c][::-1]
        before = rows[rows > 0] - 1
        _push(back, t, before[smaller[before]])
    out[1] = np.array([len(t) - 1])
    return np.concatenate(out)


def _by_doubling(t: np.ndarray) -> np.ndarray:
    rank, h, n = np.unique(t, return_inverse=True)[1].astype(np.int64), 1, len(t)
    while True:
        pair = rank * (n + 1)
        pair[: n - h] += rank[h:] + 1
        order = np.argsort(pair)
        pair = pair[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(pair[1:] != pair[:-1])))
        if new[order[-1]] == n - 1:
            return order
        rank, h = new, 2 * h


def prefix_sums(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums from which `span` reads the hash of any stretch of `t`."""
    sums = np.zeros(len(t) + 1, np.uint64)
    np.cumsum((t.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(t)), out=sums[1:])
    return sums, powers(_INVERSE, len(t) + 1)


def span(sums: np.ndarray, down: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return (sums[stop] - sums[start]) * down[start]


def suffix_array(t: np.ndarray, sigma: int | None = None) -> np.ndarray:
    """Order of the suffixes of `t`, whose last symbol is 0 and occurs only there."""
    t = np.asarray(t, np.int64)
    n = len(t)
    if n < 3:
        return np.arange(n - 1, -1, -1)
    sigma = int(t.max()) + 1 if sigma is None else sigma
    if sigma > _BUCKETS:
        return _by_doubling(t)
    smaller = _types(t)
    is_lms = smaller.copy()
    is_lms[0] = False
    is_lms[1:] &= ~smaller[:-1]
    lms = np.flatnonzero(is_lms)
    rough = _induce(t, smaller, lms, sigma)
    rough = rough[is_lms[rough]]
    ends = np.concatenate((lms[1:] + 1, [n]))
    sums, down = prefix_sums(t)
    place = np.searchsorted(lms, rough)
    length, content = ends[place] - rough, span(sums, down, rough, ends[place])
    name = np.zeros(len(lms), np.int64)
    name[place] = np.concatenate(([0], np.cumsum((length[1:] != length[:-1]) | (content[1:] != content[:-1]))))
    names = int(name.max()) + 1
    order = rough if names == len(lms) else lms[suffix_array(name, names)]
    return _induce(t, smaller, order, sigma)


def permuted_prefixes(t: np.ndarray, order: np.ndarray, most: int = 255) -> np.ndarray:
    """For every place of `t`, how many symbols (at most `most`) its suffix shares with the one before it in `order`.

    `order` may leave out suffixes; places that it leaves out, and its first, share none.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    here = np.flatnonzero(before >= 0)
    there, shared = before[here], np.zeros(len(here), np.int64)
    sums, down = prefix_sums(t)
    step = 1 << (most.bit_length() - 1)
    while step:
        if n >= step:
            a, b = here + shared, there + shared
            room = (a + step <= n) & (b + step <= n) & (shared + step <= most)
            a, b = np.minimum(a, n - step), np.minimum(b, n - step)
            shared += step * (room & (span(sums, down, a, a + step) == span(sums, down, b, b + step)))
        step >>= 1
    out = np.zeros(n, np.int64)
    out[here] = shared
    return out
