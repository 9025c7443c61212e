"""Compare a Spark result with what DuckDB returns for the query's SQL."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return connection


def difference(spark_df, connection, sql: str, exact: bool = True) -> str | None:
    """None when both sides hold the same columns and rows, else what differs."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    expected = result.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    order = sorted(names)
    types = dict(spark_df.dtypes)
    wrong = [(c, types[c], kinds[c]) for c in order if not _same_type(types[c], kinds[c])]
    if wrong:
        return f"types {wrong}"
    left = sorted((tuple(row[c] for c in order) for row in spark_df.collect()), key=_key)
    place = [names.index(c) for c in order]
    right = sorted((tuple(row[i] for i in place) for row in expected), key=_key)
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)}"
    for a, b in zip(left, right):
        for column, x, y in zip(order, a, b):
            if not _equal(x, y, exact):
                return f"{column}: {x!r} != {y!r} in {a} / {b}"
    return None


def _same_type(spark_type: str, sql_type: str) -> bool:
    pairs = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    return pairs.get(spark_type) == sql_type


def _key(row):
    return tuple((v is None, round(v, 4) if isinstance(v, float) else v if v is not None else 0) for v in row)


def _equal(x, y, exact: bool) -> bool:
    if isinstance(x, float) and isinstance(y, float):
        return x == y or (math.isnan(x) and math.isnan(y)) or (not exact and math.isclose(x, y, rel_tol=1e-9))
    return x == y
