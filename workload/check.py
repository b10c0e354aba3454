"""Compare registered queries with their SQL on one data folder.

    python -m workload.check [folder] [key ...]
"""

from __future__ import annotations

import sys
import time

import duckdb

from studyloom.session import build_session
from workload.queries import CHECKS, QUERIES

ALL_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date",
    "TIMESTAMP": "timestamp_ntz", "BOOLEAN": "boolean",
}


def checker(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in ALL_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def normal(rows, order):
    def cell(v):
        return f"{v:.6f}" if isinstance(v, float) else repr(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> tuple[str, int]:
    """What differs, empty when nothing does, and the row count."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: TYPES.get(str(d[1]), str(d[1])) for d in result.description}
    expected = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", 0
    if wrong := [(c, t, types[c]) for c, t in df.dtypes if types[c] != t]:
        return f"types {wrong}", 0
    got = [tuple(r) for r in df.collect()]
    if len(got) != len(expected):
        return f"rows {len(got)} != {len(expected)}", len(got)
    a = normal(got, [df.columns.index(c) for c in sorted(names)])
    b = normal(expected, [names.index(c) for c in sorted(names)])
    for x, y in zip(a, b):
        if x != y:
            return f"values {x} != {y}", len(got)
    return "", len(got)


def main(argv: list[str]) -> int:
    folder = argv[0] if argv else "/root/testdata/sf0.01"
    keys = argv[1:] or list(QUERIES)
    spark = build_session("local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = checker(folder)
    bad = 0
    for key in keys:
        start = time.time()
        try:
            df = QUERIES[key](spark, folder)
            if key in CHECKS:
                problem, n = compare(df, con, CHECKS[key])
                rows = f" rows={n}"
            else:
                problem, rows = "", f" rows={df.count()} (no SQL)"
        except Exception as e:  # noqa: BLE001
            problem, rows = f"{type(e).__name__}: {str(e)[:600]}", ""
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {key} {time.time() - start:.1f}s{rows} {problem}", flush=True)
    print(f"{len(keys) - bad}/{len(keys)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
