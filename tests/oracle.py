"""Runs a query and its SQL on the smallest tables and compares all rows."""

import math
import os
from pathlib import Path

import duckdb

FOLDER = Path(os.environ.get("WEFTLINE_TESTDATA", "/root/testdata/sf0.001"))


def connect():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("+00:00", "")
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def same(spark, con, query, sql):
    df = query(spark, str(FOLDER))
    got = rows_of(df.columns, df.collect())
    said = con.execute(sql)
    want = rows_of([c[0] for c in said.description], said.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
