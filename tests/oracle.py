"""Runs registered queries on Spark and their SQL on DuckDB and compares the results.

    python -m tests.oracle [sf] [name-prefix ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

from riskloom.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


# Queries without SQL, which tests/test_models.py and tests/test_plans.py check by their properties.
CHECKED_ELSEWHERE = (
    "random_forest", "boosted_trees", "parameter_search", "time_series_validation", "cross_entity_validation", "repeated_scores", "feature_set_experiments", "importances",
)


def oracle_session():
    return build_session(
        "riskloom-tests",
        f"local[{os.environ.get('BENCH_CPUS', '8')}]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.driver.host": "127.0.0.1",
            "spark.driver.bindAddress": "127.0.0.1",
        },
    )


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(v + 0.0 if v else 0.0)
    if isinstance(v, decimal.Decimal):
        return f"dec:{v}"
    if isinstance(v, dt.datetime):
        return v.strftime("%Y-%m-%d %H:%M:%S.%f")
    return f"{type(v).__name__}:{v}"


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, folder) -> tuple[bool, str, int]:
    got_df = fn(spark, folder)
    got_cols, got = _rows(got_df.columns, [tuple(r) for r in got_df.collect()])
    if sql is None:
        known = any(fn.__name__ == n for n in CHECKED_ELSEWHERE) or fn.__module__.startswith("riskloom.llm")
        empty = [c for i, c in enumerate(got_cols) if got and all(r[i] == "NULL" for r in got)]
        ok = known and bool(got) and not empty
        return ok, "rows only" if ok else f"no SQL: known={known} rows={len(got)} columns without a value: {empty}", len(got)
    rel = con.execute(sql)
    want_cols, want = _rows([d[0] for d in rel.description], rel.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}", len(got)
    if len(got) != len(want):
        miss = [r for r in want if r not in set(got)][:2]
        extra = [r for r in got if r not in set(want)][:2]
        return False, f"rows {len(got)} != {len(want)}; sql only {miss}; spark only {extra}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return False, f"{len(bad)} of {len(got)} rows differ on {got_cols}: spark {bad[0][0]} sql {bad[0][1]}", len(got)
    return True, "ok", len(got)


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry

    sf = argv[0] if argv else "sf0.01"
    folder = f"/root/testdata/{sf}"
    spark = oracle_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    queries, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in sorted(queries):
        if len(argv) > 1 and not any(name.startswith(p) for p in argv[1:]):
            continue
        t = time.time()
        try:
            ok, note, n = compare(spark, con, queries[name], sqls.get(name), folder)
        except Exception as e:  # report and go on with the next query
            ok, note, n = False, f"{type(e).__name__}: {str(e)[:700]}", -1
        failed += not ok
        if not ok or os.environ.get("VERBOSE") or n == 0:
            print(f"{'ok  ' if ok else 'FAIL'} {name} rows={n} {time.time() - t:.1f}s {note}", flush=True)
    print(f"failed={failed}")
    return failed


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1:]), 1))
