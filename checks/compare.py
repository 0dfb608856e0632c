"""Run registered queries against their SQL and report differences.

    python -m checks.compare FOLDER [name ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks import catalog, oracle
from tillflow.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


# Spark type -> DuckDB type
SAME_TYPE = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def _normal(value):
    if isinstance(value, bool) or value is None:
        return value
    return float(f"{value:.15g}") if isinstance(value, (int, float)) else value


def _rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(_normal(r[i]) for i in order) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


def difference(spark: SparkSession, connection: duckdb.DuckDBPyConnection, folder: str, name: str) -> str | None:
    """What differs between a query and its SQL, or ``None``."""
    result = catalog.queries()[name](spark, folder)
    mine = _rows(result.columns, result.collect())
    statement = connection.execute(oracle.statements()[name])
    names = [d[0] for d in statement.description]
    types = sorted((d[0], str(d[1])) for d in statement.description)
    theirs = _rows(names, statement.fetchall())
    if sorted((n, SAME_TYPE.get(t, t)) for n, t in result.dtypes) != types:
        return f"columns {sorted(result.dtypes)} != {types}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)} rows"
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(wrong)} of {len(mine)} rows differ, e.g. {wrong[0]}" if wrong else None


def main(folder: str, names: list[str]) -> int:
    spark, connection, bad = local_session(), connect(folder), 0
    for name in names or list(catalog.queries()):
        begun = time.time()
        try:
            problem = difference(spark, connection, folder, name)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{name:36s} {time.time() - begun:6.2f}s  {problem or 'ok'}", flush=True)
    print(f"{bad} of {len(names or catalog.queries())} differ")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1], sys.argv[2:]), 1))
