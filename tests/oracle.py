"""Run registered queries next to their SQL twins and compare every value."""

from __future__ import annotations

import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def compare(spark, con, folder, key, build, sql):
    """Return (message, rows, seconds in Spark); the message is None on equality."""
    began = time.time()
    frame = build(spark, folder)
    rows = frame.collect()
    spent = time.time() - began
    if sql is None:
        return None, len(rows), spent
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    other = cursor.fetchall()
    order = sorted(names)
    if sorted(frame.columns) != order:
        return f"columns {sorted(frame.columns)} != {order}", len(rows), spent
    left = sorted(repr(tuple(r[n] for n in order)) for r in rows)
    places = [names.index(n) for n in order]
    right = sorted(repr(tuple(r[p] for p in places)) for r in other)
    if left == right:
        return None, len(rows), spent
    only_left = [x for x in left if x not in set(right)]
    only_right = [x for x in right if x not in set(left)]
    return (
        f"rows {len(left)} vs {len(right)}; differ {len(only_left)}/{len(only_right)}\n"
        f"   {order}\n   spark {only_left[:3]}\n   sql   {only_right[:3]}",
        len(rows),
        spent,
    )


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as entry_module
    from labtrail.session import local_session

    folder = "/root/testdata/sf0.01"
    picks = sys.argv[1:]
    spark = local_session(8)
    con = connect(folder)
    oracles = entry_module.oracle_sql()
    bad = 0
    for key, build in entry_module.queries().items():
        if picks and not any(key == p or (p.endswith("*") and key.startswith(p[:-1])) for p in picks):
            continue
        try:
            message, count, spent = compare(spark, con, folder, key, build, oracles.get(key))
        except Exception as problem:  # noqa: BLE001
            message, count, spent = f"{type(problem).__name__}: {str(problem)[:700]}", -1, 0.0
        mark = "ok  " if message is None else "FAIL"
        bad += message is not None
        print(f"{mark} {key:28s} {count:7d} rows {spent:6.2f}s {'' if key in oracles else '(rows only)'}", flush=True)
        if message:
            print("   " + message, flush=True)
    print("failures:", bad)
