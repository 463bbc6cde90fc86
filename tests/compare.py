"""Compare a Spark result with the result of its SQL on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def rows_of(names: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(df, connection, sql: str) -> list[str]:
    """Empty when columns, types and all rows agree."""
    relation = connection.sql(sql)
    spark_names, spark_rows = rows_of(df.columns, df.collect())
    sql_names, sql_rows = rows_of(relation.columns, relation.fetchall())
    if spark_names != sql_names:
        return [f"columns {spark_names} != {sql_names}"]
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    spark_kinds = {n: kinds.get(k, k) for n, k in df.dtypes}
    sql_kinds = dict(zip(relation.columns, map(str, relation.types)))
    found = [
        f"type of {n}: {spark_kinds[n]} != {sql_kinds[n]}"
        for n in spark_names
        if spark_kinds[n] != sql_kinds[n]
    ]
    if len(spark_rows) != len(sql_rows):
        found.append(f"{len(spark_rows)} rows != {len(sql_rows)}")
    elif spark_rows != sql_rows:
        found += [f"{a} != {b}" for a, b in zip(spark_rows, sql_rows) if a != b][:5]
    return found
