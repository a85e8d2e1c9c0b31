"""Row comparison of a Spark result with the DuckDB result of the same query."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(x):
    if x is None:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5) + 0.0
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, dt.date):
        return dt.datetime(x.year, x.month, x.day)
    return x


def rows(columns, values) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(v[i]) for i in order) for v in values)


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, otherwise what differs."""
    got_columns = list(spark_df.columns)
    got = rows(got_columns, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    want_columns = [d[0] for d in cursor.description]
    want = rows(want_columns, cursor.fetchall())
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(set(got_columns) ^ set(want_columns))}"
    if got != want:
        extra, lost = got - want, want - got
        return (
            f"rows {sum(got.values())} vs {sum(want.values())}; {sum(extra.values())} differ in {sorted(got_columns)}; "
            f"spark {list(extra)[:2]}; sql {list(lost)[:2]}"
        )
    return None
