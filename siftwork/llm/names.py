"""Column names beside those of a caller's table, which may be any."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """A column by its whole name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(df: DataFrame) -> DataFrame:
    """`df` with the names c0, c1, ...: Arrow functions take no names with dots or backticks."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def free(name: str, taken: Iterable[str]) -> str:
    """`name`, with as many underscores as it takes to begin none of the names `taken` in any case."""
    used = [t.lower() for t in taken]
    while any(t.startswith(name.lower()) for t in used):
        name += "_"
    return name


def without(names: Iterable[str], others: Iterable[str]) -> list[str]:
    """The `names` that equal none of `others` in any case."""
    used = {o.lower() for o in others}
    return [n for n in names if n.lower() not in used]
