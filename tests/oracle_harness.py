"""Run a registered query in Spark and its DuckDB oracle; compare like the driver does
(column names sorted, row count, order-insensitive values)."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 4)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(_norm(x) for x in v.values())
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    return v


def compare(spark, name: str, fn, sql: str, sf_dir: str, con=None):
    sdf = fn(spark, sf_dir)
    scols = sorted(sdf.columns)
    srows = [tuple(_norm(r[c]) for c in scols) for r in sdf.collect()]
    con = con or duck(sf_dir)
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows_raw = res.fetchall()
    order = sorted(range(len(dcols)), key=lambda i: dcols[i])
    drows = [tuple(_norm(r[i]) for i in order) for r in drows_raw]
    out = {
        "name": name,
        "cols_match": scols == sorted(dcols),
        "spark_cols": scols,
        "duck_cols": sorted(dcols),
        "spark_rows": len(srows),
        "duck_rows": len(drows),
    }
    key = lambda r: tuple((x is None, str(x)) for x in r)
    ss, dd = sorted(srows, key=key), sorted(drows, key=key)
    out["values_match"] = ss == dd
    if not out["values_match"]:
        sset, dset = set(map(str, ss)), set(map(str, dd))
        out["only_spark"] = sorted(sset - dset)[:3]
        out["only_duck"] = sorted(dset - sset)[:3]
    return out
