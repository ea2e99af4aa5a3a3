"""Spark results against the same query in another engine, as sorted rows of text."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def rows(names, records):
    def text(v):
        if v is None or v != v:
            return "null"
        if isinstance(v, bool):
            return str(int(v))
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([names[i] for i in order] for _ in range(1)), sorted(tuple(text(r[i]) for i in order) for r in records)


def assert_same(df, con, sql):
    other = con.execute(sql)
    names = [d[0] for d in other.description]
    assert rows(df.columns, df.collect()) == rows(names, other.fetchall())
