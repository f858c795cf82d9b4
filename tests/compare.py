"""Compare queries with their oracle SQL in DuckDB.

    python tests/compare.py [folder] [query ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def cell(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, con, folder: str, name: str, query, sql: str | None) -> str | None:
    """None if equal, else a description of the difference."""
    df = query(spark, folder)
    mine = canonical(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if mine else "no rows"
    con.execute(sql)
    theirs_columns = [d[0] for d in con.description]
    theirs = canonical(theirs_columns, con.fetchall())
    if sorted(df.columns) != sorted(theirs_columns):
        return f"columns {sorted(df.columns)} != {sorted(theirs_columns)}"
    if mine == theirs:
        return None if mine else "both empty"
    a, b = set(map(repr, mine)), set(map(repr, theirs))
    return (
        f"rows {len(mine)} vs {len(theirs)}; {sorted(df.columns)}\n"
        f"    only spark ({len(a - b)}): {sorted(a - b)[:3]}\n    only sql ({len(b - a)}): {sorted(b - a)[:3]}"
    )


def main() -> int:
    import __spark_entry__ as contract
    from leasegrain.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    oracle = contract.oracle_sql()
    wanted = sys.argv[2:]
    failed = 0
    for name, query in contract.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            problem = compare(spark, con, folder, name, query, oracle.get(name))
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        mark = "ok " if problem is None else "BAD"
        failed += problem is not None
        print("\n" + mark, name, f"{time.time() - start:.1f}s", "" if oracle.get(name) else "(no oracle)", problem or "", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
