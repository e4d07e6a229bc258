"""Compare a query with its SQL in DuckDB, without regard to row order."""

import decimal
import glob
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6) + 0.0
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


def key(row):
    return [(x is None, str(x)) for x in row]


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=key)


def connect(folder):
    c = duckdb.connect()
    for p in glob.glob(folder + "/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rows_of_sql(connection, sql):
    r = connection.execute(sql)
    have = [d[0] for d in r.description]
    names = sorted(have)
    at = [have.index(c) for c in names]
    return names, sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=key)
