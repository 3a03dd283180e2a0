"""Counts over whole texts that quality rules and the quality classifier share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from siftwork.llm import words as w
from siftwork.llm.names import col, numbered

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_chars", "n_lines", "n_upper", "n_digits", "n_marks", "n_shouts", "n_same_words", "n_distinct_words", "n_long_words",
)
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_MARKS = np.isin(np.arange(256), list(b".,;:?'\"()-"))
LONG_WORD = 20  # bytes


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeats(owner: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (owner, key); whether the entry equals the one before, and the one after."""
    order = np.lexsort((keys, owner))
    o, k = owner[order], keys[order]
    same = np.zeros(len(o), bool)
    same[1:] = (o[1:] == o[:-1]) & (k[1:] == k[:-1])
    return order, same, np.concatenate((same[1:], [False]))[: len(o)]


def _dup_lines(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate((offsets[:-1][offsets[:-1] < offsets[1:]], breaks + 1)))
    begin = begin[begin < len(data)]
    if not len(begin):
        return np.zeros(n, np.int64)
    owner = np.searchsorted(offsets, begin, "right") - 1
    stop = np.minimum(np.concatenate((begin[1:], [len(data)])), offsets[owner + 1])
    stop = stop - ((stop > begin) & (data[stop - 1] == 10))
    worded = np.searchsorted(starts, stop) > np.searchsorted(starts, begin)
    begin, stop, owner = begin[worded], stop[worded], owner[worded]
    order, again, _ = _repeats(owner, w.word_hashes(data, begin, stop))
    return np.bincount(owner[order][again], minlength=n)


def counts(column: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of every text (null: none), whole texts, as 64-bit integers."""
    data, offsets = w.utf8(column)
    n = len(offsets) - 1
    starts, ends, owner = w.word_bounds(data, offsets)
    hashes = w.word_hashes(data, starts, ends)
    lead = (data & 0xC0) != 0x80
    points = np.concatenate(([0], np.cumsum(lead, dtype=np.int64)))
    by_word = lambda values: np.bincount(owner, values, minlength=n).astype(np.int64)

    runs = w.window_hashes(hashes, w.SHINGLE)
    first = np.flatnonzero(owner[: len(runs)] == owner[w.SHINGLE - 1 :][: len(runs)])
    order, again, next_again = _repeats(owner[first], runs[first])
    twice = first[order][again | next_again]
    cover = np.zeros(len(owner) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + w.SHINGLE, -1)

    _, seen, _ = _repeats(owner, hashes)
    repeated = np.bincount(np.sort(owner)[seen], minlength=n)
    after_same = np.zeros(len(owner), bool)
    after_same[1:] = (owner[1:] == owner[:-1]) & (hashes[1:] == hashes[:-1])
    n_words = np.bincount(owner, minlength=n)
    return {
        "n_words": n_words,
        "word_chars": by_word(points[ends] - points[starts]),
        "n_symbols": _per_text(_SYMBOLS[data], offsets),
        "n_dup_lines": _dup_lines(data, offsets, starts),
        "n_repeat_words": by_word(np.cumsum(cover)[: len(owner)] > 0),
        "n_chars": _per_text(lead, offsets),
        "n_lines": _per_text(data == 10, offsets),
        "n_upper": _per_text((data >= 65) & (data <= 90), offsets),
        "n_digits": _per_text((data >= 48) & (data <= 57), offsets),
        "n_marks": _per_text(_MARKS[data], offsets),
        "n_shouts": _per_text(data == 33, offsets),
        "n_same_words": by_word(after_same),
        "n_distinct_words": n_words - repeated,
        "n_long_words": by_word(ends - starts > LONG_WORD),
    }


def with_counts(df, text: str, names: tuple[str, ...] = COUNTS, prefix: str = "", keep: list[str] | None = None):
    """The columns `keep` (all unless given) of `df` and the counts of its column `text`, one pass over the rows."""
    keep = df.columns if keep is None else keep
    read = list(dict.fromkeys([*keep, text]))
    rows_of = numbered(df.select(*[col(c) for c in read]))
    kinds = [f.dataType for f in rows_of.schema][: len(keep)] + [T.LongType()] * len(names)
    schema = T.StructType([T.StructField(f"c{k}", kind) for k, kind in enumerate(kinds)])
    text_at = read.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in w.chunks(batches, f"c{text_at}"):
            found = counts(rows.column(text_at))
            columns = [rows.column(k) for k in range(len(keep))] + [pa.array(found[n], pa.int64()) for n in names]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows_of.mapInArrow(run, schema).toDF(*keep, *[f"{prefix}{n}" for n in names])
