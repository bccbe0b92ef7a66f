"""Run a catalog query and its SQL on the same tables and compare the results."""

from __future__ import annotations

import math
import time
from typing import Any

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def norm(v: Any) -> Any:
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, int):
        return v
    return str(v)


KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE",
    "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP",
}


def compare(df, con: duckdb.DuckDBPyConnection, sql: str, timing: dict[str, float] | None = None) -> list[str]:
    """Problems found; empty when names, types and values agree."""
    cols = sorted(df.columns)
    rel = con.sql(sql)
    other = sorted(rel.columns)
    if cols != other:
        return [f"columns {cols} != {other}"]
    problems = []
    kinds = {c: str(t) for c, t in zip(rel.columns, rel.types, strict=True)}
    for f in df.schema.fields:
        want = KINDS.get(f.dataType.simpleString(), f.dataType.simpleString())
        if kinds[f.name] != want:
            problems.append(f"type of {f.name}: {want} != {kinds[f.name]}")
    start = time.time()
    collected = df.collect()
    between = time.time()
    fetched = rel.fetchall()
    if timing is not None:
        timing.update(spark=between - start, sql=time.time() - between)
    mine = sorted((tuple(norm(r[c]) for c in cols) for r in collected), key=repr)
    order = [rel.columns.index(c) for c in cols]
    theirs = sorted((tuple(norm(r[i]) for i in order) for r in fetched), key=repr)
    if len(mine) != len(theirs):
        problems.append(f"rows {len(mine)} != {len(theirs)}")
    if mine != theirs:
        a, b = set(mine), set(theirs)
        problems.append(f"only spark {sorted(a - b, key=repr)[:3]} only sql {sorted(b - a, key=repr)[:3]}")
    if not mine:
        problems.append("no rows")
    return problems
