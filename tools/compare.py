"""Run registered queries next to their SQL in DuckDB and report differences.

Usage: python tools/compare.py [folder] [name-prefix ...]
"""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd

from cyclelake.plans import registry
from cyclelake.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def cells(frame: pd.DataFrame) -> list[tuple]:
    """Rows as sorted tuples of plain values, columns in name order."""

    def plain(value):
        if isinstance(value, (list, tuple)) or type(value).__name__ == "ndarray":
            return str([plain(v) for v in value])
        if isinstance(value, dict):
            return str({k: plain(v) for k, v in value.items()})
        if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
            return "~"
        if type(value).__name__ in ("bool", "bool_"):
            return str(bool(value))
        if isinstance(value, float):
            return repr(value + 0.0)
        return str(value)

    ordered = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(plain(v) for v in row) for row in ordered.itertuples(index=False, name=None))


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} / {sorted(want.columns)}"
    left, right = cells(got), cells(want)
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    if left != right:
        pairs = [(a, b) for a, b in zip(left, right) if a != b]
        return f"{len(pairs)} rows differ, first:\n   spark {pairs[0][0]}\n   duck  {pairs[0][1]}"
    return None


def type_notes(spark_types: dict[str, str], duck_types: dict[str, str]) -> str:
    same = {
        "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
        "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE",
        "array<string>": "VARCHAR[]",
    }
    odd = [
        f"{n}:{k}/{duck_types.get(n)}" for n, k in spark_types.items() if same.get(k, k) != str(duck_types.get(n))
    ]
    return " types " + ", ".join(odd) if odd else ""


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = local_session(cores="8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sql = registry.oracle_sql()
    bad = 0
    for name, build in registry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        started = time.time()
        try:
            df = build(spark, folder)
            kinds = dict(df.dtypes)
            got = pd.DataFrame([r.asDict(recursive=True) for r in df.collect()], columns=df.columns)
            took = time.time() - started
            if name in sql:
                result = con.execute(sql[name])
                kinds_duck = {d[0]: d[1] for d in result.description}
                want = pd.DataFrame(result.fetchall(), columns=[d[0] for d in result.description])
                problem = difference(got, want)
                note = type_notes(kinds, kinds_duck)
            else:
                problem, note = None, " (rows only)"
            print(f"{'DIFF' if problem else 'ok  '} {name} {len(got)} rows {took:.1f}s{note}", flush=True)
            if problem:
                bad += 1
                print("   " + problem, flush=True)
        except Exception as error:  # report and go on with the next query
            bad += 1
            print(f"FAIL {name}: {str(error)[:1500]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print(f"{bad} problems")
    return bad


if __name__ == "__main__":
    sys.exit(main())
