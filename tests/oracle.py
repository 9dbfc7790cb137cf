"""Runs a query and its SQL and compares the rows."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return db


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, datetime.datetime):
        return str(value)
    return value


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(names), sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark, sf_dir, query, sql):
    frame = query(spark, sf_dir)
    got = sorted_rows(frame.columns, [tuple(r) for r in frame.collect()])
    result = database(sf_dir).execute(sql)
    want = sorted_rows([d[0] for d in result.description], result.fetchall())
    assert got == want
