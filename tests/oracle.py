"""Compare a query with its SQL in DuckDB, ignoring row order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return round(v, 5)
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(_plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=str)


def differences(spark, query, sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    want = rows_of(names, found.fetchall())
    if sorted(df.columns) != sorted(names):
        return [("columns", df.columns, names)]
    if len(got) != len(want):
        return [("rows", len(got), len(want), list(set(got) - set(want))[:2], list(set(want) - set(got))[:2])]
    return [(a, b) for a, b in zip(got, want, strict=True) if a != b][:3]
