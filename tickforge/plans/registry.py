"""Named queries with the SQL that checks each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def portable(sql: str) -> str:
    """round(x, n) written as floor(x * 10^n + 0.5001) / 10^n: engines and orders of summing differ on halves."""
    while (at := sql.find("round(")) >= 0:
        depth, end, comma = 1, at + 6, 0
        while depth:
            depth += {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}.get(sql[end], 0)
            if sql[end] == "," and depth == 1:
                comma = end
            end += 1
        inside, places = (sql[at + 6 : comma], int(sql[comma + 1 : end - 1])) if comma else (sql[at + 6 : end - 1], 0)
        sql = f"{sql[:at]}(floor(({inside}) * 1e{places} + 0.5001e0) / 1e{places}){sql[end:]}"
    return sql


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a function as the query of its name; sql None: no SQL expresses it."""

    def put(function: Query) -> Query:
        own = name or function.__name__
        QUERIES[own] = function
        if sql is not None:
            ORACLE_SQL[own] = portable(sql)
        return function

    return put
