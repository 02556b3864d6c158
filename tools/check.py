"""Compare registered queries with their SQL twins: ``check.py [sf] [name ...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def session(cpus: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return int(v) if v == int(v) and abs(v) < 1e15 else v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def main(sf="0.01", *names):
    from tablewright import workload

    workload.load_all()
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    spark = session()
    bad = 0
    for name, fn in workload.QUERIES.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            got = rows(df.columns, df.collect())
        except Exception as exc:
            bad += 1
            print(f"ERROR {name}: {str(exc)[:1500]}", flush=True)
            continue
        took = time.time() - start
        if name not in workload.ORACLES:
            print(f"rows  {name}: {len(got)} rows {took:.1f}s {str(got[:2])[:300] if names else ''}", flush=True)
            continue
        try:
            s2 = time.time()
            cur = con.execute(workload.ORACLES[name])
            cols = [d[0] for d in cur.description]
            want = rows(cols, cur.fetchall())
            t2 = time.time() - s2
        except Exception as exc:
            bad += 1
            print(f"SQLERR {name}: {str(exc)[:800]}", flush=True)
            continue
        if sorted(cols) != sorted(df.columns):
            bad += 1
            print(f"COLS  {name}: {sorted(df.columns)} / {sorted(cols)}", flush=True)
        elif got != want:
            bad += 1
            diff = [(a, b) for a, b in zip(got, want) if a != b][:3]
            print(f"DIFF  {name}: {len(got)} / {len(want)} rows; {str(diff)[:900]}", flush=True)
        else:
            print(f"ok    {name}: {len(got)} rows {took:.1f}s (sql {t2:.1f}s)", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(*sys.argv[1:]) else 0)
