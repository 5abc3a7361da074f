"""Side-by-side run of a query and its SQL."""

from __future__ import annotations

import duckdb

# The test tables.
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def _plain(x):
    if isinstance(x, float):
        return round(x, 9) + 0.0
    return x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x


def differences(spark_rows, spark_columns, con, sql: str):
    """None when both agree, else a short description."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want_cols, want = canon(names, cursor.fetchall())
    got_cols, got = canon(list(spark_columns), [tuple(r) for r in spark_rows])
    if want_cols != got_cols:
        return f"columns {got_cols} instead of {want_cols}"
    if len(want) != len(got):
        return f"{len(got)} rows instead of {len(want)}"
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None
