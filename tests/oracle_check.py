"""Run registered keys in Spark and in DuckDB and compare them the way the
driver does: row count, column names, order-insensitive value hash.

Usage: python tests/oracle_check.py [sf_dir] [key ...]
"""

from __future__ import annotations

import hashlib
import math
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        return f"{v:.6g}"
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "item"):
        try:
            return _norm(v.item())
        except Exception:
            pass
    return str(v)


def digest(rows: list[tuple], cols: list[str]) -> tuple[int, list[str], str]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("\x1f".join(_norm(r[i]) for i in order) for r in rows)
    return len(rows), [cols[i] for i in order], hashlib.sha256("\n".join(lines).encode()).hexdigest()


def compare(spark, con, sf_dir: str, key: str, queries, oracle) -> dict:
    t0 = time.time()
    df = queries[key](spark, sf_dir)
    srows = [tuple(r) for r in df.collect()]
    scols = df.columns
    t1 = time.time()
    res = {"key": key, "spark_s": round(t1 - t0, 2), "rows": len(srows)}
    if key not in oracle:
        res["oracle"] = "none"
        return res
    rel = con.sql(oracle[key])
    orows = rel.fetchall()
    ocols = rel.columns
    a, b = digest(srows, scols), digest(orows, ocols)
    res.update(
        oracle_rows=len(orows),
        rows_match=a[0] == b[0],
        cols_match=a[1] == b[1],
        hash_match=a[2] == b[2],
    )
    if not (res["rows_match"] and res["cols_match"] and res["hash_match"]):
        res["spark_cols"], res["oracle_cols"] = a[1], b[1]
        so = sorted("\x1f".join(_norm(r[scols.index(c)]) for c in a[1]) for r in srows)
        oo = sorted("\x1f".join(_norm(r[ocols.index(c)]) for c in b[1]) for r in orows) if a[1] == b[1] else []
        diff_s = [x for x in so if x not in set(oo)][:3]
        diff_o = [x for x in oo if x not in set(so)][:3]
        res["only_spark"], res["only_oracle"] = diff_s, diff_o
    return res


def main():
    from __spark_entry__ import oracle_sql, queries

    from docdrift.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:]
    spark = local_session()
    con = duck(sf_dir)
    qs, os_ = queries(), oracle_sql()
    bad = 0
    for k in keys or sorted(qs):
        try:
            r = compare(spark, con, sf_dir, k, qs, os_)
        except Exception as e:  # report and continue
            r = {"key": k, "error": (type(e).__name__ + ": " + str(e))[:1500]}
        ok = r.get("oracle") == "none" or (r.get("rows_match") and r.get("cols_match") and r.get("hash_match"))
        bad += 0 if ok else 1
        print(("OK  " if ok else "BAD ") + str(r), flush=True)
    print(f"{len(keys or qs) - bad} ok, {bad} bad")


if __name__ == "__main__":
    main()
