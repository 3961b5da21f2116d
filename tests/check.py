"""Run registered queries next to their SQL and report differences.

    python -m tests.check [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        if os.path.exists(f"{sf_dir}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(out, key=repr)


def compare(spark, con, name, query, sql, sf_dir):
    started = time.time()
    df = query(spark, sf_dir)
    got = df.collect()
    spent = time.time() - started
    columns, left = rows_of(df.columns, [tuple(r) for r in got])
    if sql is None:
        return True, f"{name}: {len(left)} rows, no SQL, {spent:.1f}s"
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    other_columns, right = rows_of(names, result.fetchall())
    if columns != other_columns:
        return False, f"{name}: columns differ {columns} / {other_columns}"
    if left != right:
        ours, theirs = set(left), set(right)
        only_left = [r for r in left if r not in theirs][:3]
        only_right = [r for r in right if r not in ours][:3]
        return False, (
            f"{name}: {len(left)} / {len(right)} rows differ {columns}\n   spark {only_left}\n"
            f"   sql   {only_right}"
        )
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    kinds = {d[0]: str(d[1]) for d in result.description}
    note = "" if left else " (EMPTY)"
    odd = [
        f"{c}:{types[c]}/{kinds[c]}" for c in columns
        if {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
            "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}.get(types[c]) != kinds[c]
    ]
    return True, f"{name}: ok {len(left)} rows{note} {spent:.1f}s {odd or ''}"


def main(argv):
    import __spark_entry__ as entry
    from repograph.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session(os.environ.get("CHECK_CPUS", "8"))
    con = duck(sf_dir)
    oracle = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if len(argv) > 1 and not any(name.startswith(p) for p in argv[1:]):
            continue
        try:
            ok, line = compare(spark, con, name, query, oracle.get(name), sf_dir)
        except Exception as error:  # report and go on
            ok, line = False, f"{name}: {type(error).__name__} {str(error)[:1500]}"
        bad += not ok
        print(("  " if ok else "! ") + line, flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
