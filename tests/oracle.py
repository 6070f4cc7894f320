"""Rows of a query against those of its SQL."""

import math
from pathlib import Path

import duckdb


def connect(sf_dir):
    db = duckdb.connect()
    db.sql("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        db.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return db


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return int(v) if isinstance(v, int) else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def assert_same(df, db, sql):
    found = db.execute(sql)
    names = [c[0] for c in found.description]
    want = rows_of(names, found.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
