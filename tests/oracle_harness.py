"""Spark-vs-DuckDB comparison in the shape the verification driver uses:
row count, column names, and an order-insensitive hash of the values.

Run directly: ``python tests/oracle_harness.py [sf_dir] [name ...]``.
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if isinstance(v, pd.Timestamp):
        return v.isoformat()
    return str(v)


def frame_hash(df: pd.DataFrame) -> str:
    cols = sorted(df.columns)
    rows = sorted("|".join(_norm(r[c]) for c in cols) for r in df[cols].to_dict("records"))
    return hashlib.sha256("\n".join(rows).encode()).hexdigest()


def compare(spark, name: str, sf_dir: str, queries: dict, oracles: dict) -> dict:
    t0 = time.time()
    sdf = queries[name](spark, sf_dir).toPandas()
    t1 = time.time()
    out = {"name": name, "spark_rows": len(sdf), "spark_sec": round(t1 - t0, 2)}
    if name not in oracles:
        out["oracle"] = "none"
        return out
    con = duck_connection(sf_dir)
    ddf = con.sql(oracles[name]).df()
    out["oracle_rows"] = len(ddf)
    out["columns_match"] = sorted(sdf.columns) == sorted(ddf.columns)
    if not out["columns_match"]:
        out["spark_cols"] = sorted(sdf.columns)
        out["oracle_cols"] = sorted(ddf.columns)
        return out
    hs, hd = frame_hash(sdf), frame_hash(ddf)
    out["hash_match"] = hs == hd
    if hs != hd:
        cols = sorted(sdf.columns)
        a = sorted("|".join(_norm(r[c]) for c in cols) for r in sdf[cols].to_dict("records"))
        b = sorted("|".join(_norm(r[c]) for c in cols) for r in ddf[cols].to_dict("records"))
        sa, sb = set(a), set(b)
        out["only_spark"] = sorted(sa - sb)[:3]
        out["only_oracle"] = sorted(sb - sa)[:3]
        out["cols"] = cols
    return out


def main(argv: list[str]) -> int:
    from tillroll.session import build_session
    import __spark_entry__ as entry_mod

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or list(entry_mod.queries())
    spark = build_session(shuffle_partitions=8)
    queries, oracles = entry_mod.queries(), entry_mod.oracle_sql()
    bad = 0
    for name in names:
        res = compare(spark, name, sf_dir, queries, oracles)
        ok = res.get("oracle") == "none" or (
            res.get("hash_match") and res["spark_rows"] == res.get("oracle_rows")
        )
        bad += not ok
        print(("OK  " if ok else "BAD ") + str(res), flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
