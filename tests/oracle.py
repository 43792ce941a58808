"""Compare a query with its oracle: same columns, same rows in any order."""

from __future__ import annotations

import decimal
import math

import duckdb


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    return value


def duck_rows(sql: str, sf_dir: str):
    import os

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in sorted(os.listdir(sf_dir)):
        if f.endswith(".parquet"):
            where = f"{sf_dir}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else "")
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{where}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in got.fetchall()), key=repr)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=repr)
