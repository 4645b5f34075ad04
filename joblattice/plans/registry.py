"""Queries register here together with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, days: str = "") -> Callable[[Query], Query]:
    """Register a function (spark, sf_dir) under its name; the columns in ``days`` are written as YYYY-MM-DD."""
    names = days.split()

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, sf_dir).withColumns({d: F.col(d).cast("string") for d in names})
        if sql is not None:
            SQL[f.__name__] = f"SELECT * REPLACE ({', '.join(f'CAST(CAST({d} AS DATE) AS VARCHAR) AS {d}' for d in names)}) FROM ({sql})" if names else sql
        return f

    return register
