"""Compare registered queries with their SQL on DuckDB: rows, names, types, values."""

from __future__ import annotations

import glob
import math
import os
import time

import duckdb
import pandas as pd


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _kind(dtype: str) -> str:
    return "O" if dtype in ("object", "string", "str") else dtype


def _rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    def norm(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or v is pd.NA or v is pd.NaT:
            return "null"
        if isinstance(v, float):
            return f"{v:.9g}"
        if hasattr(v, "item"):
            v = v.item()
        return str(v)
    return sorted(tuple(norm(v) for v in row) for row in frame.astype(object).itertuples(index=False))


def compare(spark_df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    got = spark_df.toPandas()
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    types = [(c, _kind(str(got[c].dtype)), _kind(str(want[c].dtype))) for c in sorted(got.columns)]
    off = [t for t in types if t[1] != t[2]]
    a, b = _rows(got), _rows(want)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(diff)} rows differ, e.g. {diff[0]}; types {off}"
    return f"types {off}" if off else None


def main(names=None, sf="0.01"):
    import sys
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from nestfold.session import get_session
    spark = get_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="16g",
                        spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    d = f"/root/testdata/sf{sf}"
    con = connect(d)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, d)
            if name in oracles:
                verdict = compare(df, con, oracles[name])
            else:
                verdict = None if df.count() > 0 else "no rows"
        except Exception as e:  # report and go on
            verdict = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += verdict is not None
        print(f"{time.time() - start:6.2f}s {'ok  ' if verdict is None else 'FAIL'} {name} {'' if name in oracles else '(rows only)'} {verdict or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    import sys
    args = sys.argv[1:]
    sf = args.pop(0)[3:] if args and args[0].startswith("sf=") else "0.01"
    main(args or None, sf)
