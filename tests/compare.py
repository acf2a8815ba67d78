"""Run registered queries on Spark and their statements on DuckDB and compare the results.

Usage: python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def table(names, rows):
    """Columns by name, rows in a fixed order."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(out, key=repr)


def spark_table(df):
    return table(df.columns, [tuple(r) for r in df.collect()])


def duck_table(con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return table(names, cursor.fetchall())


def difference(got, want) -> str | None:
    """None when equal, else a short description."""
    if got[0] != want[0]:
        return f"columns {got[0]} against {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows against {len(want[1])}"
    for a, b in zip(got[1], want[1]):
        if a != b:
            return f"{dict(zip(got[0], a))} against {dict(zip(want[0], b))}"
    return None


def main() -> int:
    import time

    import __spark_entry__ as entry
    from session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    con = duck(sf_dir)
    statements = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            got = spark_table(query(spark, sf_dir))
            seconds = time.time() - start
            found = difference(got, duck_table(con, statements[name])) if name in statements else None
            size = len(got[1])
        except Exception as e:  # report and go on with the next query
            found, size, seconds = f"{type(e).__name__}: {str(e)[:600]}", 0, time.time() - start
        bad += found is not None
        print(f"{'ok ' if found is None else 'BAD'} {name:34s} {size:7d} rows {seconds:6.2f} s  {found or ''}", flush=True)
    print(f"{bad} of {len(entry.queries())} differ")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
