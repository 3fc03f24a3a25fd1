"""Holds a query's rows against DuckDB's for its SQL, as sorted rows with columns by name."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def ordered(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=lambda r: tuple((v is None, str(type(v)), v) for v in r))


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, ordered(df.select(*[f"`{c}`" for c in columns]).collect())


def duck_rows(con, sql):
    columns = sorted(d[0] for d in con.execute(f"DESCRIBE {sql}").fetchall())
    return columns, ordered(con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())
