"""Run registered queries beside their SQL and compare the results."""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or v is pd.NaT or v is pd.NA:
        return "~"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (int, bool)) or hasattr(v, "item") and not isinstance(v, str):
        v = v.item() if hasattr(v, "item") else v
        if isinstance(v, bool):
            return str(v)
        return repr(round(float(v), 6) + 0.0) if isinstance(v, (int, float)) else str(v)
    return str(v)


def rows_of(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    return sorted(tuple(_cell(v) for v in row) for row in pdf[cols].astype(object).itertuples(index=False))


def kinds(pdf: pd.DataFrame) -> dict[str, str]:
    return {c: ("bool" if pdf[c].dtype.kind == "b" else pdf[c].dtype.kind if pdf[c].dtype.kind in "M" else "x") for c in pdf.columns}


def compare(spark, con, folder, name, fn, sql) -> str | None:
    got = fn(spark, folder).toPandas()
    if sql is None:
        return None if len(got.columns) else "no columns"
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} against {sorted(want.columns)}"
    a, b = rows_of(got), rows_of(want)
    if len(got) and (differ := {c: k for c, k in kinds(got).items() if k != kinds(want)[c] and got[c].notna().all()}):
        return f"types {differ} against {({c: kinds(want)[c] for c in differ})}"
    if a == b:
        return None
    sa, sb = set(a), set(b)
    only_a, only_b = [r for r in a if r not in sb][:3], [r for r in b if r not in sa][:3]
    return f"{len(a)} rows against {len(b)}; only in Spark {only_a}; only in SQL {only_b}"


if __name__ == "__main__":
    from assetlake.session import build_session
    from assetlake.workload.registry import oracle_sql, queries

    folder = sys.argv[1]
    picked = sys.argv[2:]
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": 8, "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("OFF")
    con, sqls, bad = connect(folder), oracle_sql(), 0
    for name, fn in queries().items():
        if picked and not any(name.startswith(p) for p in picked):
            continue
        t0 = time.time()
        try:
            msg = compare(spark, con, folder, name, fn, sqls.get(name))
        except Exception as e:  # report and go on
            msg = f"{type(e).__name__}: {str(e)[:600]}"
        bad += msg is not None
        print(f"{'ok ' if msg is None else 'BAD'} {name} {time.time() - t0:.1f}s {'' if name in sqls else '(no sql)'} {msg or ''}", flush=True)
    print("bad:", bad)
