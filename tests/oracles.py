"""Runs a query and its DuckDB oracle over the same tables and compares their rows without order."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def rows_of(frame) -> tuple[list[str], list[tuple]]:
    columns = sorted(frame.columns)
    return columns, sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)


def oracle_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    with duckdb.connect() as connection:
        for name in TABLES:
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
        result = connection.execute(sql)
        names = [d[0] for d in result.description]
        columns = sorted(names)
        order = [names.index(c) for c in columns]
        return columns, sorted((tuple(plain(r[k]) for k in order) for r in result.fetchall()), key=repr)
