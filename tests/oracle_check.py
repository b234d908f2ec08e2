"""Compare registered queries with their SQL in DuckDB: ``python tests/oracle_check.py [dir] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir: str, name: str, run, sql: str | None):
    started = time.time()
    df = run(spark, sf_dir)
    rows = [tuple(row) for row in df.collect()]
    spent = time.time() - started
    if sql is None:
        return "rows-only", len(rows), spent, ""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = result.fetchall()
    left, right = canonical(df.columns, rows), canonical(names, expected)
    if left == right:
        return "ok", len(rows), spent, ""
    detail = f"columns {left[0]} vs {right[0]}" if left[0] != right[0] else f"rows {len(rows)} vs {len(expected)}"
    a, b = set(left[1]), set(right[1])
    detail += f"\n  only spark: {sorted(a - b)[:3]}\n  only sql:   {sorted(b - a)[:3]}"
    return "DIFFERS", len(rows), spent, detail


def main() -> int:
    from pulsegrid.session import local_session
    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con, sql = local_session(), duck(sf_dir), entry.oracle_sql()
    failed = 0
    for name, run in entry.queries().items():
        if wanted and name not in wanted:
            continue
        try:
            status, rows, spent, detail = compare(spark, con, sf_dir, name, run, sql.get(name))
        except Exception as error:  # report every query, whatever happens to one of them
            status, rows, spent, detail = "ERROR", 0, 0.0, str(error)[:1500]
        failed += status in ("DIFFERS", "ERROR")
        print(f"{status:10} {name:28} {rows:8} rows {spent:6.2f} s {detail}", flush=True)
    print("unmatched sql:", sorted(set(sql) - set(entry.queries())), "failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
