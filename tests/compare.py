"""Spark result against DuckDB result: same columns, same rows as multisets."""

from __future__ import annotations

import os
from collections import Counter

import duckdb

SOURCES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()

# Types that hold the same values in the two engines.
SAME_TYPES = {
    "STRING": "VARCHAR",
    "INT": "INTEGER",
    "BIGINT": "BIGINT",
    "DOUBLE": "DOUBLE",
    "VOID": "VARCHAR",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in SOURCES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def multiset(rows, columns) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def differences(df, con, sql: str) -> list[str]:
    """What differs, in words; empty when nothing does."""
    relation = con.sql(sql)
    if sorted(df.columns) != sorted(relation.columns):
        return [f"columns {sorted(df.columns)} != {sorted(relation.columns)}"]
    theirs = dict(zip(relation.columns, map(str, relation.types)))
    found = [
        f"type of {name}: {kind} != {theirs[name]}"
        for name, kind in df.dtypes
        if SAME_TYPES.get(kind.upper(), kind.upper()) != theirs[name]
    ]
    mine = multiset([tuple(row) for row in df.collect()], df.columns)
    other = multiset(relation.fetchall(), relation.columns)
    if mine != other:
        only_mine, only_other = mine - other, other - mine
        found.append(
            f"{sum(mine.values())} rows, {sum(other.values())} in SQL;"
            f" only Spark {list(only_mine)[:2]}; only SQL {list(only_other)[:2]}"
        )
    return found
