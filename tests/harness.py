"""Comparison of a query with its DuckDB oracle."""

import glob
import os

import duckdb

SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return [plain(x) for x in value] if isinstance(value, list | tuple) else value


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted(repr([plain(row[c]) for c in columns]) for row in df.collect())


def oracle_rows(sql, sf_dir=SF):
    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        db.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    found = db.execute(sql)
    names = [x[0] for x in found.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted(repr([plain(row[i]) for i in order]) for row in found.fetchall())


def same(df, sql, sf_dir=SF):
    got, want = rows_of(df), oracle_rows(sql, sf_dir)
    assert got[0] == want[0]
    assert got[1] == want[1]
