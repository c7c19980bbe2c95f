"""Runs registered queries next to their SQL on DuckDB and compares names, row counts, values and types."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else (int(v) if v == int(v) and abs(v) < 1e15 else float(f"{v:.9g}"))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


_TYPES = {"VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "DATE": "date", "BOOLEAN": "boolean"}


def diff(spark_df, rel) -> list[str]:
    """Differences between a Spark result and a DuckDB relation, empty when equal."""
    s_cols, d_cols = sorted(spark_df.columns), sorted(rel.columns)
    if s_cols != d_cols:
        return [f"columns {s_cols} != {d_cols}"]
    out = []
    s_types = dict(spark_df.dtypes)
    d_types = {c: _TYPES.get(str(t), str(t).lower()) for c, t in zip(rel.columns, rel.types)}
    bad = {c: (s_types[c], d_types[c]) for c in s_cols if s_types[c] != d_types[c]}
    if bad:
        out.append(f"types {bad}")
    a = sorted([tuple(norm(r[c]) for c in s_cols) for r in spark_df.collect()], key=repr)
    idx = [rel.columns.index(c) for c in s_cols]
    b = sorted([tuple(norm(r[i]) for i in idx) for r in rel.fetchall()], key=repr)
    if len(a) != len(b):
        out.append(f"rows {len(a)} != {len(b)}")
    if a != b:
        sa, sb = set(map(repr, a)), set(map(repr, b))
        out.append(f"only spark {sorted(sa - sb)[:3]} only sql {sorted(sb - sa)[:3]}")
    if not a:
        out.append("no rows")
    return out
