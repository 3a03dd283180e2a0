"""Rows and the class each belongs to, joined so that no class of any size fills one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT = 512


def join_classes(rows: DataFrame, classes: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """`rows` with the columns of `classes`, a table with one row per key and the number `size` of its rows.

    Classes of more than total / HOT rows, fewer than HOT of them whatever the data, are broadcast;
    after that no key of the shuffle has more rows than this. `how` is inner or left.
    """
    hot = classes.filter(F.col(size) * HOT > total)
    near = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return near.unionByName(rest.join(classes.filter(F.col(size) * HOT <= total), keys, how))
