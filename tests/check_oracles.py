"""Compare registered queries with their SQL twins: python tests/check_oracles.py [sf] [name ...]"""

from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").appName("tidemark-check")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


def kind(values):
    names = {type(v).__name__ for v in values if v is not None}
    return "/".join(sorted(names)) or "null"


def compare(spark, db, run, sql, sf_dir):
    """None when equal, else what differs."""
    df = run(spark, sf_dir)
    names = sorted(df.columns)
    ours = [tuple(plain(r[n]) for n in names) for r in df.collect()]
    cursor = db.execute(sql)
    head = [d[0] for d in cursor.description]
    if sorted(head) != names:
        return f"columns {names} vs {sorted(head)}", len(ours)
    order = [head.index(n) for n in names]
    theirs = [tuple(plain(row[i]) for i in order) for row in cursor.fetchall()]
    if len(ours) != len(theirs):
        return f"rows {len(ours)} vs {len(theirs)}", len(ours)
    key = lambda row: tuple((v is not None, str(type(v).__name__ if not isinstance(v, (int, float)) else "n"), v if v is not None else 0) for v in row)
    ours.sort(key=key)
    theirs.sort(key=key)
    for i, n in enumerate(names):
        a, b = kind(r[i] for r in ours), kind(r[i] for r in theirs)
        if a != b and "null" not in (a, b):
            return f"type of {n}: {a} vs {b}", len(ours)
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if bad:
        return f"{len(bad)} rows differ {names}: {bad[0][0]} vs {bad[0][1]}", len(ours)
    return None, len(ours)


def main(argv):
    from tidemark import catalog

    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    only = argv[1:]
    spark, db = session(), database(sf_dir)
    oracles, bad = catalog.oracle_sql(), 0
    for name, run in catalog.queries().items():
        if only and not any(o in name or name == o for o in only):
            continue
        start = time.time()
        try:
            if name in oracles:
                why, rows = compare(spark, db, run, oracles[name], sf_dir)
            else:
                why, rows = None, len(run(spark, sf_dir).collect())
        except Exception as error:  # report and go on with the next query
            why, rows = f"{type(error).__name__}: {str(error)[:900]}", -1
        bad += why is not None
        mark = "ok  " if why is None else "BAD "
        tail = "" if name in oracles else " (rows only)"
        print(f"{mark}{name} rows={rows} {time.time() - start:.1f}s{tail}{' :: ' + why if why else ''}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
