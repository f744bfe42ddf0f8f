"""Compares registered queries with their SQL: ``python tests/oracle.py [folder] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def multiset(columns: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    counted = Counter(tuple(_cell(r[i]) for i in order) for r in rows)
    return [columns[i] for i in order], counted


def difference(spark, con, folder: str, run, sql: str) -> str | None:
    df = run(spark, folder)
    found = multiset(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    wanted = multiset([c[0] for c in cursor.description], cursor.fetchall())
    if found[0] != wanted[0]:
        return f"columns {found[0]} != {wanted[0]}"
    if found[1] != wanted[1]:
        extra, lacking = found[1] - wanted[1], wanted[1] - found[1]
        return (
            f"{found[1].total()} rows, expected {wanted[1].total()}; "
            f"{extra.total()} extra like {list(extra)[:2]}; {lacking.total()} lacking like {list(lacking)[:2]}"
        )
    return None


def main() -> None:
    import __spark_entry__ as contract
    from labelscope.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark, con, sql = local_session(os.environ.get("CORES", "8"), memory="8g"), connect(folder), contract.oracle_sql()
    bad = 0
    for name, run in contract.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            problem = difference(spark, con, folder, run, sql[name]) if name in sql else f"no SQL, {run(spark, folder).count()} rows"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print(f"{bad} differences")


if __name__ == "__main__":
    main()
