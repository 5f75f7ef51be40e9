"""Rows of a query and of its SQL, in one order and one form."""

import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return int(v)
    if isinstance(v, bytearray):
        return bytes(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def compare(df, sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    r = con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(r.columns)
    at = [r.columns.index(n) for n in names]
    got = sorted((tuple(plain(x[n]) for n in names) for x in df.collect()), key=repr)
    want = sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)
    assert got == want
    assert got
