"""Runs registered queries and their SQL twins side by side. Also a script: compare.py SF_DIR [name ...]"""

from __future__ import annotations

import decimal
import datetime
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def spark_session(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sigward")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def simple_type(t: str) -> str:
    t = t.lower().split("(")[0]
    return {"varchar": "string", "integer": "int", "bool": "boolean", "timestamp": "timestamp_ntz"}.get(t, t)


def compare(spark, con, sf_dir: str, name: str, fn, sql: str | None) -> str:
    """Empty when equal, else what differs."""
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return ""
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}"
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    sql_types = {d[0]: simple_type(str(d[1])) for d in cur.description}
    off = {c: (spark_types[c], sql_types[c]) for c in columns if simple_type(spark_types[c]) != sql_types[c]}
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if a != b:
        extra = [r for r in a if r not in set(b)][:2]
        lack = [r for r in b if r not in set(a)][:2]
        return f"rows {len(a)} vs {len(b)}: only spark {str(extra)[:400]}, only sql {str(lack)[:400]}"
    return f"types {off}" if off else ""


def main() -> int:
    import __spark_entry__ as entry

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = spark_session(), duck(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = [q for q in queries if not names or any(q.startswith(n) for n in names)]
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, name, queries[name], oracle.get(name))
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(problem)
        n = "" if problem else "ok"
        print(f"{name:34s} {time.time() - start:6.2f}s {n}{problem}", flush=True)
    print(f"{len(names)} queries, {bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main())
