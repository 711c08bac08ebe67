"""Side-by-side check of a Spark query against its DuckDB oracle SQL."""
from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v
    if hasattr(v, "item"):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(df: pd.DataFrame):
    cols = sorted(df.columns)
    out = []
    for r in df[cols].itertuples(index=False):
        out.append(tuple(_norm(x) for x in r))
    return cols, out


def _key(r):
    return tuple((0, "") if x is None else (1, repr(round(x, 6)) if isinstance(x, float) else repr(x))
                 for x in r)


def compare(spark_df, con, sql: str, tol: float = 1e-9):
    """Return (ok, exact, message)."""
    s = spark_df.toPandas()
    o = con.sql(sql).df()
    sc, sr = _rows(s)
    oc, orr = _rows(o)
    if sc != oc:
        return False, False, f"columns differ: spark={sc} oracle={oc}"
    if len(sr) != len(orr):
        return False, False, f"row count spark={len(sr)} oracle={len(orr)}"
    sr.sort(key=_key)
    orr.sort(key=_key)
    exact = True
    for a, b in zip(sr, orr):
        for c, x, y in zip(sc, a, b):
            if x == y:
                continue
            if isinstance(x, (int, float)) and isinstance(y, (int, float)) and not isinstance(x, bool):
                if abs(float(x) - float(y)) <= tol * max(1.0, abs(float(x))):
                    exact = False
                    continue
            return False, False, f"value differs in {c}: spark={x!r} oracle={y!r}\n{a}\n{b}"
    return True, exact, f"{len(sr)} rows"
