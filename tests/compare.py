"""Run a query on Spark and its oracle on DuckDB, and compare the rows."""

import datetime
import decimal
import math
from collections import Counter

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        f = float(v)
        return None if math.isnan(f) else (0.0 if f == 0 else f)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return sorted(df.columns), rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return sorted(names), rows_of(names, cur.fetchall())


def difference(df, con, sql, show=3):
    """Empty text when equal."""
    a_names, a = spark_rows(df)
    b_names, b = duck_rows(con, sql)
    if a_names != b_names:
        return f"columns differ: spark {set(a_names) - set(b_names)} oracle {set(b_names) - set(a_names)}"
    if a == b:
        return ""
    only_a, only_b = a - b, b - a
    return (f"rows spark {sum(a.values())} oracle {sum(b.values())}; only spark {sum(only_a.values())}, "
            f"only oracle {sum(only_b.values())}\n  {a_names}\n  spark  {sorted(only_a, key=str)[:show]}\n"
            f"  oracle {sorted(only_b, key=str)[:show]}")
