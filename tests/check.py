"""Runs queries next to their oracle SQL: python tests/check.py [sf_dir] [query ...]."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def oracle_rows(sf_dir, sql):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return names, cursor.fetchall()


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v + 0.0)
        return repr(v)

    return sorted(names), sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, query, sql, sf_dir):
    result = query(spark, sf_dir)
    got = normal(result.columns, [tuple(r) for r in result.collect()])
    want = normal(*oracle_rows(sf_dir, sql))
    return got, want


def main():
    import __spark_entry__ as entry
    from corpusweave.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.oracle_sql())
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in names:
        start = time.time()
        try:
            got, want = compare(spark, entry.queries()[name], entry.oracle_sql()[name], sf_dir)
            ok = got == want
            note = "" if ok else f"{got[0]} {want[0]} {len(got[1])} {len(want[1])}"
            if not ok:
                diff = [(g, w) for g, w in zip(got[1], want[1]) if g != w][:2]
                note += "\n   " + str(diff)[:1500]
        except Exception as error:  # noqa: BLE001
            ok, note = False, f"{type(error).__name__}: {str(error)[:1200]}"
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - start:.2f}s {note}", flush=True)
    print("all equal" if not bad else f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main())
