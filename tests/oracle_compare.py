"""Compares a registered query with its SQL, the way the driver does: by name-sorted columns."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from siftwork.plans.oracles import ORACLES
from siftwork.plans.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return db


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def differences(spark: SparkSession, db: duckdb.DuckDBPyConnection, folder: str, name: str) -> str | None:
    """None when both sides hold the same rows (in any order), else what differs."""
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    ours = Counter(tuple(_plain(row[c]) for c in columns) for row in df.collect())
    result = db.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return f"columns {columns} vs {sorted(names)}"
    order = [names.index(c) for c in columns]
    theirs = Counter(tuple(_plain(row[i]) for i in order) for row in result.fetchall())
    if ours == theirs:
        types = _types(df, dict(zip(names, [str(d[1]) for d in result.description])))
        return f"types {types}" if types else None
    only_ours, only_theirs = list((ours - theirs).items())[:3], list((theirs - ours).items())[:3]
    return f"{columns}: {sum(ours.values())} vs {sum(theirs.values())} rows; only ours {only_ours}; only theirs {only_theirs}"


# Spark's type names and the oracle's for the same values.
_SAME = {"bigint": "BIGINT", "string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def _types(df, theirs: dict[str, str]) -> dict[str, tuple[str, str]]:
    return {name: (kind, theirs[name]) for name, kind in df.dtypes if _SAME.get(kind) != theirs[name]}
