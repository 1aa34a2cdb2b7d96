"""Order-insensitive comparison of a Spark result with a DuckDB oracle."""

from __future__ import annotations

import collections
import datetime as _dt
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, digits: int):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, digits) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, _dt.date):
        return v.isoformat()
    if hasattr(v, "asDict"):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.asDict().items()))
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.items()))
    return v


def compare(sdf, con, sql: str, digits: int = 6) -> dict:
    s_cols = sorted(sdf.columns)
    rel = con.sql(sql)
    d_cols = sorted(rel.columns)
    out = {"spark_cols": s_cols, "duck_cols": d_cols, "cols_match": s_cols == d_cols}
    srows = [tuple(_norm(r[c], digits) for c in s_cols) for r in sdf.collect()]
    drows_raw = rel.fetchall()
    idx = [rel.columns.index(c) for c in d_cols]
    drows = [tuple(_norm(r[i], digits) for i in idx) for r in drows_raw]
    out["spark_rows"], out["duck_rows"] = len(srows), len(drows)
    cs, cd = collections.Counter(srows), collections.Counter(drows)
    out["values_match"] = cs == cd
    if cs != cd:
        out["only_spark"] = list((cs - cd).elements())[:3]
        out["only_duck"] = list((cd - cs).elements())[:3]
    return out
