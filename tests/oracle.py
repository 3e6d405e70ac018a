"""Compares queries with their SQL on the driver's tables."""

import glob
import math
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return f"{float(value):.6g}"
    return str(value)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found), [columns[i] for i in order]


def compare(spark, con, query, sql):
    df = query(spark, SF)
    ours, names = rows(df.columns, [tuple(r) for r in df.collect()])
    got = con.execute(sql)
    theirs, other = rows([d[0] for d in got.description], got.fetchall())
    assert names == other
    assert len(ours) == len(theirs), (len(ours), len(theirs))
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    assert not wrong, wrong[:3]
    return len(ours)
