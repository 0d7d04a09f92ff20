"""Compares every query with its SQL: python tests/oracle_check.py [sf_dir] [names...]"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if hasattr(value, "as_tuple"):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 6) if math.isfinite(value) else str(value)
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


def compare(spark, connection, sf, name, query, sql):
    started = time.time()
    df = query(spark, sf)
    got = canonical(df.columns, df.collect())
    seconds = time.time() - started
    if sql is None:
        return seconds, len(got[1]), None
    cursor = connection.execute(sql)
    want = canonical([d[0] for d in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return seconds, len(got[1]), f"columns {got[0]} / {want[0]}"
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        return seconds, len(got[1]), f"rows {len(got[1])} / {len(want[1])}: only Spark {sorted(a - b)[:3]} only SQL {sorted(b - a)[:3]}"
    return seconds, len(got[1]), ""


def connect(sf):
    import duckdb

    connection = duckdb.connect()
    for t in TABLES.split():
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return connection


def main():
    import __spark_entry__ as entry

    from voxtide.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark, connection = local_session(8, 8), connect(sf)
    sqls, bad = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        try:
            seconds, rows, problem = compare(spark, connection, sf, name, query, sqls.get(name))
        except Exception as error:
            seconds, rows, problem = 0.0, 0, f"error {str(error)[:700]}"
        bad += bool(problem)
        verdict = "rows only" if problem is None else ("ok" if not problem else "WRONG " + problem)
        print(f"{name:28s} {seconds:6.2f}s {rows:8d} {verdict}", flush=True)
    print("unknown oracle keys:", sorted(set(sqls) - set(entry.queries())))
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
