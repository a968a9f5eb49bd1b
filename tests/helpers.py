"""Comparison of Spark results with DuckDB over the same files."""

import datetime
import glob
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in glob.glob(folder + "/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(value):
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, float):
        return int(value) if value.is_integer() else round(value, 6)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value).replace(" 00:00:00", "")
    return value


def rows_of(df) -> list[str]:
    names = sorted(df.columns)
    return sorted(repr([plain(r[n]) for n in names]) for r in df.collect())


def sql_rows(con, sql: str) -> tuple[list[str], list[str]]:
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(repr([plain(r[i]) for i in order]) for r in got.fetchall())
