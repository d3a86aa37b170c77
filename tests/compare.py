"""Comparison of a Spark result with a DuckDB result on the same tables."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(os.path.join(folder, "*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _value(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value + 0.0, 9)
    return value


def rows_of(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_value(row[i]) for i in order) for row in rows)


def difference(spark_df, connection, sql: str) -> str | None:
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    wanted = rows_of(names, result.fetchall())
    found = rows_of(spark_df.columns, [tuple(row) for row in spark_df.collect()])
    if found == wanted:
        return None
    extra, missing = list((found - wanted).items())[:2], list((wanted - found).items())[:2]
    return f"rows {found.total()} vs {wanted.total()}; only here {extra}; only there {missing}"
