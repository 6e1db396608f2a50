"""Run registered queries and their SQL side by side and report differences."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    return str(v)


def kind(v):
    return "num" if isinstance(v, (int, float)) and not isinstance(v, bool) else type(v).__name__


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, folder: str, name: str, make, sql: str | None):
    """(status, details, seconds)."""
    t = time.time()
    df = make(spark, folder)
    names, rows = df.columns, [tuple(r) for r in df.collect()]
    took = time.time() - t
    if sql is None:
        return "rows", f"{len(rows)} rows", took
    cur = con.execute(sql)
    other_names, other = [c[0] for c in cur.description], cur.fetchall()
    if sorted(names) != sorted(other_names):
        return "FAIL", f"columns {sorted(names)} != {sorted(other_names)}", took
    a, b = rows_of(names, rows), rows_of(other_names, other)
    if a == b:
        for n in names:  # int against float would hash differently
            x = next((r[names.index(n)] for r in rows if r[names.index(n)] is not None), None)
            y = next((r[other_names.index(n)] for r in other if r[other_names.index(n)] is not None), None)
            if type(x) is not type(y) and not isinstance(x, (list, tuple)):
                return "TYPE", f"{n}: {type(x).__name__} / {type(y).__name__}", took
        return "ok", f"{len(rows)} rows", took
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return "FAIL", f"{len(a)} / {len(b)} rows; spark only {len(only_a)} {only_a[:2]}; sql only {len(only_b)} {only_b[:2]}", took


def session(shared: str | None = None):
    from pyspark.sql import SparkSession

    builder = SparkSession.builder
    if shared is not None:
        builder = builder.config("spark.checkpoint.dir", shared)
    spark = (
        builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(folder: str, wanted: list[str]) -> int:
    import __spark_entry__ as entry

    spark, con = session(), database(folder)
    sql, bad, total = entry.oracle_sql(), 0, 0.0
    for name, make in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            status, details, took = compare(spark, con, folder, name, make, sql.get(name))
        except Exception as e:  # noqa: BLE001 - reported, and the run goes on
            status, details, took = "ERROR", f"{type(e).__name__}: {str(e)[:600]}", 0.0
        bad += status not in ("ok", "rows")
        total += took
        print(f"{status:5} {name:36} {took:6.2f}s {details}", flush=True)
    print(f"{bad} bad, {total:.1f}s")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
