"""Run registered queries on Spark and their SQL on DuckDB, and compare the rows.

    python tests/check_oracles.py [sf_dir] [query ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shaped = []
    for row in rows:
        values = []
        for i in order:
            v = row[i]
            if isinstance(v, float):
                v = round(v, 9)
            values.append(repr(v))
        shaped.append(tuple(values))
    return sorted(columns), sorted(shaped)


def spark_rows(df):
    return canonical(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    result = con.execute(sql)
    return canonical([d[0] for d in result.description], result.fetchall())


def main() -> None:
    from tests.conftest import make_spark

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(entry.queries())
    spark, con = make_spark(), duck(sf_dir)
    bad = 0
    for name in chosen:
        started = time.time()
        try:
            mine = spark_rows(entry.queries()[name](spark, sf_dir))
        except Exception as error:  # report and go on with the next query
            bad += 1
            print(f"ERROR {name}: {str(error)[:600]}")
            continue
        took = time.time() - started
        sql = entry.oracle_sql().get(name)
        if sql is None:
            print(f"rows  {name}: {len(mine[1])} rows, {took:.1f} s")
            continue
        try:
            theirs = duck_rows(con, sql)
        except Exception as error:
            bad += 1
            print(f"SQLER {name}: {str(error)[:600]}")
            continue
        same = mine == theirs
        bad += not same
        print(
            f"{'ok   ' if same else 'DIFF '} {name}: {len(mine[1])}/{len(theirs[1])} rows, "
            f"{took:.1f} s, sql {time.time() - started - took:.1f} s"
        )
        if not same:
            print("   columns", mine[0], theirs[0])
            left, right = set(mine[1]), set(theirs[1])
            for row in list(left - right)[:3]:
                print("   spark", str(row)[:400])
            for row in list(right - left)[:3]:
                print("   sql  ", str(row)[:400])
    print("failed:", bad)


if __name__ == "__main__":
    main()
