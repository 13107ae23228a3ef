"""Run registered queries and their SQL side by side: python scripts/check_oracle.py [folder] [name ...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from airlog.session import local_session  # noqa: E402
from queries import load  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 9))
    return repr(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows), [names[i] for i in order]


def main(folder: str, only: list[str]) -> int:
    SparkSession.builder.config("spark.ui.showConsoleProgress", "false")
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    registry, bad = load(), 0
    names = [n for n in registry.QUERIES if not only or any(o in n for o in only)]
    for name in names:
        began = time.time()
        try:
            df = registry.QUERIES[name](spark, folder)
            mine, columns = rows_of(df.columns, df.collect())
            took = time.time() - began
            if name not in registry.ORACLES:
                print(f"rows {name}: {len(mine)} rows, {took:.2f}s, no SQL")
                continue
            result = con.execute(registry.ORACLES[name])
            theirs, other = rows_of([d[0] for d in result.description], result.fetchall())
        except Exception as error:
            bad += 1
            print(f"FAIL {name}: {str(error)[:700]}")
            continue
        if columns != other or mine != theirs:
            bad += 1
            a, b = set(mine), set(theirs)
            print(f"DIFF {name}: {len(mine)} vs {len(theirs)} rows {columns if columns != other else ''} "
                  f"{other if columns != other else ''}\n   only ours {list(a - b)[:3]}\n   only sql  {list(b - a)[:3]}")
        else:
            print(f"ok   {name}: {len(mine)} rows, {took:.2f}s")
    print(f"{len(names)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:]))
