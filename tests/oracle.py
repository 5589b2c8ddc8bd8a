"""Compares a query with its SQL in DuckDB over one directory of tables."""

import glob
import os

import duckdb

SF = "/root/testdata/sf0.001"


def connect(sf_dir: str = SF):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    return float(value) if type(value).__name__ == "Decimal" else value


def same(spark, query, sql: str, sf_dir: str = SF) -> None:
    df = query(spark, sf_dir)
    got = connect(sf_dir).execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = [tuple(plain(dict(zip(names, row))[c]) for c in order) for row in got.fetchall()]
    mine = [tuple(plain(row[c]) for c in order) for row in df.collect()]
    assert sorted(map(repr, mine)) == sorted(map(repr, want))
    assert want
