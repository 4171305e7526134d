"""Runs registered queries in Spark and their SQL in DuckDB and compares the rows as multisets."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session(cores: int = 8) -> SparkSession:
    from claimweave.scale import session_options

    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.warehouse.dir", os.environ.get("TMPDIR", "/tmp") + "/warehouse")
    )
    for key, value in session_options().items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 5) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sql, sf_dir) -> dict:
    t0 = time.time()
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    a, b = rows_of(df.columns, got), rows_of(names, want)
    return {
        "ok": sorted(df.columns) == sorted(names) and a == b,
        "columns": (sorted(df.columns), sorted(names)),
        "rows": (len(got), len(want)),
        "spark_sec": round(t1 - t0, 2),
        "duck_sec": round(t2 - t1, 2),
        "only_spark": list((a - b).items())[:3],
        "only_sql": list((b - a).items())[:3],
    }


def main(argv: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in argv)]
    spark, con = session(), database(sf_dir)
    bad = 0
    for name in names:
        try:
            if name not in oracles:
                t0 = time.time()
                n = queries[name](spark, sf_dir).count()
                print(f"rows {name}: {n} rows, {time.time() - t0:.2f}s", flush=True)
                continue
            r = compare(spark, con, queries[name], oracles[name], sf_dir)
        except Exception as e:
            bad += 1
            print(f"FAIL {name}: {type(e).__name__}: {str(e)[:1500]}", flush=True)
            continue
        print(f"{'ok  ' if r['ok'] else 'DIFF'} {name}: rows {r['rows']}, spark {r['spark_sec']}s, sql {r['duck_sec']}s", flush=True)
        if not r["ok"]:
            bad += 1
            if r["columns"][0] != r["columns"][1]:
                print("   columns", r["columns"])
            print("   only spark", str(r["only_spark"])[:1200])
            print("   only sql  ", str(r["only_sql"])[:1200])
    print("bad:", bad, "of", len(names))
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
