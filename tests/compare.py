"""Runs registered queries next to their SQL and reports differences."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return str([canonical(v) for v in value])
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def check(spark, con, folder, query, sql):
    """(ok, message, seconds in Spark, seconds in DuckDB, rows)."""
    start = time.time()
    got = query(spark, folder)
    got_columns, got_rows = rows_of(got.columns, [tuple(r) for r in got.collect()])
    middle = time.time()
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    want_columns, want_rows = rows_of(names, want.fetchall())
    end = time.time()
    times = (middle - start, end - middle, len(got_rows))
    if got_columns != want_columns:
        return False, f"columns {got_columns} != {want_columns}", *times
    if got_rows != want_rows:
        only_got = [r for r in got_rows if r not in set(want_rows)][:3]
        only_want = [r for r in want_rows if r not in set(got_rows)][:3]
        return False, f"rows {len(got_rows)} vs {len(want_rows)}; got {only_got} want {only_want}", *times
    return True, "", *times


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from __spark_entry__ import oracle_sql as all_oracles, queries as all_queries
    from packlens.session import local_session

    scale, wanted = sys.argv[1], sys.argv[2:]
    folder = f"/root/testdata/sf{scale}"
    session = local_session()
    con = connect(folder)
    queries, oracles = all_queries(), all_oracles()
    for key in wanted or queries:
        try:
            if key in oracles:
                ok, message, t_spark, t_duck, n = check(session, con, folder, queries[key], oracles[key])
                print(f"{'ok  ' if ok else 'FAIL'} {key} rows={n} spark={t_spark:.2f}s duckdb={t_duck:.2f}s {message[:900]}", flush=True)
            else:
                start = time.time()
                n = len(queries[key](session, folder).collect())
                print(f"rows {key} rows={n} spark={time.time() - start:.2f}s", flush=True)
        except Exception as exc:  # noqa: BLE001
            print(f"ERR  {key} {type(exc).__name__}: {str(exc)[:900]}", flush=True)
