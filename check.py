"""Compare queries with their SQL on the test tables.

    python check.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import importlib
import time
import traceback

import duckdb

from seepage import catalog
from seepage.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def normal(value):
    if isinstance(value, float):
        return "nan" if value != value else repr(value)
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(normal(r[i]) for i in order) for r in rows)


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--group")
    parser.add_argument("prefixes", nargs="*")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    if args.group:
        module = importlib.import_module(f"seepage.catalog.{args.group}")
        queries, oracles = module.QUERIES, module.ORACLES
    else:
        queries, oracles = catalog.collect("QUERIES"), catalog.collect("ORACLES")
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    bad = 0
    for name, query in queries.items():
        if args.prefixes and not any(name.startswith(p) for p in args.prefixes):
            continue
        try:
            start = time.time()
            df = query(spark, sf_dir)
            got = rows_of(df.columns, df.collect())
            took = time.time() - start
            if name not in oracles:
                print(f"rows  {name:32} {len(got[1]):7} rows  {took:6.2f}s", flush=True)
                continue
            start = time.time()
            result = db.execute(oracles[name])
            want = rows_of([d[0] for d in result.description], result.fetchall())
            sql_took = time.time() - start
        except Exception as e:
            bad += 1
            print(f"ERROR {name}: {str(e)[:1500]}", flush=True)
            if not str(e):
                traceback.print_exc()
            continue
        if got == want:
            print(f"ok    {name:32} {len(got[1]):7} rows  {took:6.2f}s  sql {sql_took:.2f}s", flush=True)
        else:
            bad += 1
            print(f"DIFF  {name}: {len(got[1])} vs {len(want[1])} rows; {got[0]} vs {want[0]}")
            only = [r for r in got[1] if r not in set(want[1])][:3]
            miss = [r for r in want[1] if r not in set(got[1])][:3]
            print("   got only:", str(only)[:1200])
            print("   sql only:", str(miss)[:1200], flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
