"""Compare registered queries with their check SQL: python tests/check.py [sf] [name ...]"""

import math
import os
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(cores="8"):
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", os.environ.get("CHECK_PARTITIONS", "8"))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null" if v is None else "nan"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.9g}" if isinstance(v, float) else str(v)
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return str(v)


def key(v):
    return norm(v + 0.0 if isinstance(v, float) and v == 0 else v).replace("-0", "0") if v == 0 else norm(v)


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(key(r[i]) for i in order) for r in data), sorted(cols)


def main(sf, names):
    from tideframe.catalog import ORACLES, QUERIES

    spark = session()
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = 0
    for name in names or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf)
            got, cols = rows(df.columns, df.collect())
            took = time.time() - start
            if name not in ORACLES:
                print(f"  -   {name}: {len(got)} rows, {took:.1f}s, types {[t for _, t in df.dtypes]}", flush=True)
                if not got:
                    bad += 1
                    print("EMPTY", name)
                continue
            start = time.time()
            rel = db.execute(ORACLES[name])
            types = [d[1] for d in rel.description]
            want, wcols = rows([d[0] for d in rel.description], rel.fetchall())
            if cols != wcols:
                raise AssertionError(f"columns {cols} vs {wcols}")
            if got != want:
                diff = [(a, b) for a, b in zip(got, want) if a != b][:3]
                raise AssertionError(f"{len(got)} vs {len(want)} rows; {diff}")
            print(f"  ok  {name}: {len(got)} rows, {took:.1f}s (check {time.time() - start:.1f}s)" + ("" if got else " EMPTY"), flush=True)
        except Exception as e:
            bad += 1
            text = str(e)
            print(f"FAIL  {name}: {type(e).__name__} {text[:700]}", flush=True)
            if not isinstance(e, AssertionError):
                print("   ", "".join(traceback.format_tb(e.__traceback__)[-2:])[:600])
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    folder = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    sys.exit(1 if main(folder, args) else 0)
