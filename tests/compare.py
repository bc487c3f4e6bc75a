"""Run registered queries against their DuckDB oracles: python tests/compare.py [sf_dir] [name ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    if isinstance(v, float) and v == 0:
        return 0.0
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([_plain(r[i]) for i in order] for r in rows), key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def spark_rows(df):
    return _rows(df.columns, [tuple(r) for r in df.collect()])


TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def oracle_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return dict((d[0], str(d[1])) for d in cur.description), _rows(names, cur.fetchall())


def difference(df, con, sql: str) -> str | None:
    """What differs between a query and its oracle, or None."""
    kinds, want = oracle_rows(con, sql)
    ours = {c: TYPES.get(t, t) for c, t in df.dtypes}
    if ours != kinds:
        return f"schema {sorted(set(ours.items()) ^ set(kinds.items()))}"
    got = spark_rows(df)
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} of {len(want)} rows differ, first: {bad[0]}" if bad else None


def main() -> int:
    import __spark_entry__ as entry
    from threadtide.session import get_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = get_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                        spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            note = difference(df, con, oracles[name]) if name in oracles else f"rows only: {len(df.collect())}"
        except Exception as problem:  # report and go on with the next query
            note = f"ERROR {type(problem).__name__}: {str(problem)[:600]}"
        spark.catalog.clearCache()
        failed += bool(note) and not note.startswith("rows only")
        print(f"{time.time() - start:6.1f}s {name}: {note or 'ok'}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
