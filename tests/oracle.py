"""Runs a query in Spark and its SQL in DuckDB and compares the rows."""

import math
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 6) + 0.0 if isinstance(v, float) and math.isfinite(v) else v
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, name, query, sql, sf=SF):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for f in os.listdir(sf):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    df = query(spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    want = rows([d[0] for d in found.description], found.fetchall())
    assert got[0] == want[0], f"{name}: columns {got[0]} and {want[0]}"
    different = [(g, w) for g, w in zip(got[1], want[1]) if repr(g) != repr(w)][:2]
    assert len(got[1]) == len(want[1]) and not different, f"{name}: {len(got[1])} and {len(want[1])} rows, {different}"
    return len(got[1])
