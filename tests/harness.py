"""Run registered queries and compare them with their SQL in DuckDB."""

from __future__ import annotations

import datetime as dt
import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{sf_dir}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return f"{type(v).__name__}:{v}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(_cell(r[i]) for i in order) for r in rows], key=repr)


_TYPES = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
          "DATE": "date", "TIMESTAMP": "timestamp_ntz"}


def _types_differ(df, con, sql: str) -> str | None:
    want = {r[0]: _TYPES.get(r[1], r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    off = {c: (have[c], want[c]) for c in have if have[c] != want[c]}
    return f"types {off}" if off else None


def compare(df, sql: str, con) -> str | None:
    """None when rows agree, else what differs."""
    got = df.collect()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if not want:
        return "the oracle has no rows, so the check is empty"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return _types_differ(df, con, sql)
    sa, sb = set(a), set(b)
    extra = [r for r in a if r not in sb][:3]
    lacking = [r for r in b if r not in sa][:3]
    return f"{len(a)} rows against {len(b)}; only here {extra}; only there {lacking}; columns {sorted(names)}"
