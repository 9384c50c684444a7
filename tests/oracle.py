"""Compare a query with its SQL counterpart, order-insensitively."""

from __future__ import annotations

import glob
import os

import duckdb


def duck(sf_dir: str):
    c = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def rows_of(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted((tuple(_plain(r[n]) for n in names) for r in df.collect()), key=repr)


def sql_rows(connection, sql: str) -> tuple[list[str], list[tuple]]:
    q = connection.execute(sql)
    own = [d[0] for d in q.description]
    names = sorted(own)
    at = [own.index(n) for n in names]
    return names, sorted((tuple(_plain(r[i]) for i in at) for r in q.fetchall()), key=repr)


def _plain(x):
    return round(x, 9) if isinstance(x, float) else x
