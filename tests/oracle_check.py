"""Compare registered queries with their oracle SQL: python tests/oracle_check.py [sf] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _key(value):
    if value is None:
        return (0, "")
    if isinstance(value, float):
        return (1, "nan" if math.isnan(value) else f"{value + 0.0:.6f}")
    return (2, str(value))


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_key(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, sf_dir):
    got = query(spark, sf_dir)
    columns = got.columns
    got_rows = [tuple(r) for r in got.collect()]
    if sql is None:
        return len(got_rows), None
    cursor = con.execute(sql)
    want_columns = [c[0] for c in cursor.description]
    odd = [f"{c[0]}:{c[1]}" for c in cursor.description if "HUGEINT" in str(c[1]) or "DECIMAL" in str(c[1])]
    if odd:
        return len(got_rows), f"oracle types {odd}"
    want_rows = cursor.fetchall()
    if sorted(columns) != sorted(want_columns):
        return len(got_rows), f"columns {sorted(columns)} != {sorted(want_columns)}"
    a, b = canon(got_rows, columns), canon(want_rows, want_columns)
    if a != b:
        left = [x for x in a if x not in set(b)][:3]
        right = [x for x in b if x not in set(a)][:3]
        return len(got_rows), f"rows {len(a)} vs {len(b)}; spark only {left}; oracle only {right}"
    return len(got_rows), None


def main():
    import __spark_entry__ as entry
    from locusframe.session import local_session

    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    names = args[1:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(), duck(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        began = time.time()
        try:
            count, problem = compare(spark, con, name, query, oracles.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001
            count, problem = 0, f"{type(error).__name__}: {str(error)[:1500]}"
        took = time.time() - began
        state = "FAIL" if problem else ("ok" if name in oracles else "rows-only")
        bad += bool(problem)
        print(f"{state:9s} {name:40s} {count:9d} rows {took:6.1f}s {problem or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
