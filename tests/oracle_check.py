"""Run registered queries against their SQL oracle: python tests/oracle_check.py SF_DIR [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "documents embeddings benchmark conversations pages labels".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns), kind="stable").reset_index(drop=True)


def differences(spark_rows: pd.DataFrame, oracle_rows: pd.DataFrame) -> list[str]:
    left, right = canonical(spark_rows), canonical(oracle_rows)
    if list(left.columns) != list(right.columns):
        return [f"columns {list(left.columns)} vs {list(right.columns)}"]
    if len(left) != len(right):
        return [f"rows {len(left)} vs {len(right)}"]
    found = []
    for name in left.columns:
        a, b = left[name], right[name]
        if a.dtype != b.dtype:
            found.append(f"type of {name}: {a.dtype} vs {b.dtype}")
        same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            at = same.idxmin()
            found.append(f"{name}: {int((~same).sum())} values, first {a[at]!r} vs {b[at]!r}")
    return found


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from passagework.session import local_session

    spark = local_session(cores="8")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    print("without oracle:", sorted(set(queries) - set(oracles)), "without query:", sorted(set(oracles) - set(queries)))
    bad = 0
    for name in names or queries:
        started = time.time()
        try:
            got = queries[name](spark, sf_dir).toPandas()
        except Exception as failure:
            bad += 1
            print(f"FAIL {name}: {type(failure).__name__} {str(failure)[:1500]}", flush=True)
            continue
        middle = time.time()
        try:
            want = con.execute(oracles[name]).df()
        except Exception as failure:
            bad += 1
            print(f"FAIL {name} oracle: {str(failure)[:800]}", flush=True)
            continue
        found = differences(got, want)
        bad += bool(found)
        verdict = "FAIL" if found else "ok  "
        print(f"{verdict} {name}: {len(got)} rows, spark {middle - started:.2f}s, sql {time.time() - middle:.2f}s {found}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
