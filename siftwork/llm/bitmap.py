"""A bitmap of fixed size over a column of 64-bit keys, to keep most other rows out of a join.

A key of the column is always found; another key is found with the share of set bits. The join
that follows decides. At most `MOST_BITS` bits (8 MB) are gathered and broadcast, however long the column.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BITS = 1 << 26


class Bitmap:
    def __init__(self, keys: DataFrame, key: str, expected: int) -> None:
        """The low bits of a key are its place: keys are ids in sequence or hashes."""
        self.mask = min(MOST_BITS, 1 << max(16, (16 * expected).bit_length())) - 1
        bit = F.col(key).bitwiseAND(F.lit(self.mask))
        words = keys.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word"))
        rows = words.agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("bits")).toPandas()
        table = np.zeros((self.mask + 1) >> 6, np.int64)
        table[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
        self._table = keys.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Inside a task: whether each key may be in the column."""
        bit = keys.astype(np.int64, copy=False) & self.mask
        return ((self._table.value[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
