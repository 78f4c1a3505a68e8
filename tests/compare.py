"""Runs queries against their SQL twins; usable as a script: compare.py [sf_dir] [name ...]."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def plain(value):
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def key(row):
    return tuple((x is None, str(type(x)) if not isinstance(x, (int, float)) else "", str(x)) for x in row)


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted([tuple(plain(x) for x in row) for row in df.select(*names).collect()], key=key)


def duck_rows(con, sql):
    rel = con.sql(sql)
    names = sorted(rel.columns)
    at = [rel.columns.index(n) for n in names]
    return names, sorted([tuple(plain(row[i]) for i in at) for row in rel.fetchall()], key=key)


def mismatch(left, right):
    """None if equal; otherwise a short description."""
    (ln, lr), (rn, rr) = left, right
    if ln != rn:
        return f"columns {ln} != {rn}"
    if len(lr) != len(rr):
        a, b = set(map(str, lr)), set(map(str, rr))
        return f"rows {len(lr)} != {len(rr)}; only spark {list(a - b)[:2]}; only sql {list(b - a)[:2]}"
    bad = [(x, y) for x, y in zip(lr, rr) if x != y]
    if bad:
        a, b = set(map(str, lr)), set(map(str, rr))
        return f"{len(bad)} rows differ; only spark {sorted(a - b)[:2]}; only sql {sorted(b - a)[:2]}"
    types = [(n, type(x), type(y)) for n, x, y in zip(ln, *(r[0] for r in (lr, rr))) if type(x) is not type(y)] if lr else []
    return f"types {types}" if types else None


def main(argv):
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = argv[1:] or list(queries)
    con = duck(sf)
    bad = 0
    for name in wanted:
        t0 = time.time()
        try:
            got = spark_rows(queries[name](spark, sf))
            t1 = time.time()
            if name not in oracles:
                print(f"ROWS  {name} rows={len(got[1])} {t1 - t0:.1f}s", flush=True)
                continue
            want = duck_rows(con, oracles[name])
            note = mismatch(got, want)
        except Exception as e:  # report and go on
            note, t1, got = f"{type(e).__name__}: {str(e)[:700]}", time.time(), ([], [])
        bad += note is not None
        print(f"{'OK   ' if note is None else 'FAIL '} {name} rows={len(got[1])} spark={t1 - t0:.1f}s sql={time.time() - t1:.1f}s {note or ''}", flush=True)
    print(f"{len(wanted)} run, {bad} bad")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
