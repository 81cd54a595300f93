"""Spark result against the DuckDB oracle: rows, names and values without their order."""

from __future__ import annotations

import glob
import os

import duckdb


def normal(value):
    if value is None or isinstance(value, bool | int | str):
        return str(value)
    if isinstance(value, float):
        return f"{value:.6g}"
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(normal(r[k]) for k in order) for r in rows)


def oracle(sql: str, sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    result = con.sql(sql)
    return sorted(result.columns), rows_of(result.columns, result.fetchall()), dict(zip(result.columns, map(str, result.types), strict=True))
