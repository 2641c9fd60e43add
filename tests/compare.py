"""Runs registered queries against their SQL statements in DuckDB."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)

    def cell(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return "~"
        if isinstance(v, bool):
            return str(v)
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, float) and v.is_integer():
            v = int(v)
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    return sorted(tuple(cell(v) for v in row) for row in df[cols].itertuples(index=False, name=None))


def compare(spark, con, folder: str, name: str, fn, statement: str | None):
    t = time.time()
    got = fn(spark, folder).toPandas()
    took = time.time() - t
    if statement is None:
        return len(got) >= 0, took, 0.0, f"{len(got)} rows, no SQL"
    t = time.time()
    want = con.execute(statement).df()
    sql_took = time.time() - t
    if sorted(got.columns) != sorted(want.columns):
        return False, took, sql_took, f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = normal(got), normal(want)
    if a != b:
        only = [x for x in a if x not in set(b)][:2]
        miss = [x for x in b if x not in set(a)][:2]
        return False, took, sql_took, f"{len(a)} vs {len(b)} rows; {sorted(got.columns)} only spark {only} only sql {miss}"
    return True, took, sql_took, f"{len(a)} rows"


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry

    from riskweave.session import local_session

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), connect(folder)
    qs, sqls = entry.queries(), entry.oracle_sql()
    names = [n for n in qs if not wanted or any(n == w or (w.endswith("*") and n.startswith(w[:-1])) for w in wanted)]
    bad = 0
    for n in names:
        try:
            ok, a, b, note = compare(spark, con, folder, n, qs[n], sqls.get(n))
        except Exception as error:  # noqa: BLE001
            ok, a, b, note = False, 0, 0, f"{type(error).__name__}: {str(error)[:900]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {n:12s} spark {a:6.2f}s sql {b:6.2f}s {note}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
