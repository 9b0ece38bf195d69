"""Run registered queries next to their SQL in DuckDB: ``python -m tests.compare [pattern] [sf]``."""

from __future__ import annotations

import datetime
import decimal
import math
import re
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from webtables.catalog import load

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
)
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE", "timestamp": "TIMESTAMP"}


def session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


def table_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return len(rows), None
    cur = con.execute(sql)
    names, types = [d[0] for d in cur.description], [str(d[1]) for d in cur.description]
    want = cur.fetchall()
    gn, gr = table_of(df.columns, rows)
    wn, wr = table_of(names, want)
    if gn != wn:
        return len(rows), f"columns {gn} != {wn}"
    kinds = dict(zip(names, types))
    odd = [(f.name, f.dataType.simpleString(), kinds[f.name]) for f in df.schema if KINDS.get(f.dataType.simpleString(), "?") != kinds[f.name]]
    if odd:
        return len(rows), f"types {odd}"
    if gr != wr:
        a, b = set(gr) - set(wr), set(wr) - set(gr)
        return len(rows), f"rows {len(gr)} vs {len(wr)}; only spark {len(a)} {sorted(a)[:2]}; only sql {len(b)} {sorted(b)[:2]}"
    return len(rows), None


def main(pattern: str = "", sf: str = "0.01"):
    sf_dir = f"/root/testdata/sf{sf}"
    queries, oracle = load()
    spark, con = session(), database(sf_dir)
    bad = 0
    for name, fn in queries.items():
        if not re.search(pattern, name):
            continue
        t = time.time()
        try:
            n, err = compare(spark, con, fn, oracle.get(name), sf_dir)
        except Exception as e:  # a report, not a gate
            n, err = -1, f"{type(e).__name__}: {str(e)[:700]}"
        bad += err is not None
        print(f"{'FAIL' if err else 'ok  ' if name in oracle else 'rows'} {name:28} {n:7d} rows {time.time() - t:6.2f}s {(err or '')[:900]}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main(*sys.argv[1:])
