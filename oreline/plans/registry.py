"""The table of queries: each module of plans registers its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of a table reader; ``sql`` is the same result for DuckDB."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return register


def bw(x: str) -> str:
    """DuckDB: bits of a non-negative whole number."""
    return f"(CASE WHEN ({x}) = 0 THEN 0 ELSE length(bin(({x})::BIGINT)) END)"


def uv(x: str) -> str:
    """DuckDB: bytes of a LEB128 number."""
    return f"greatest(1, ({bw(x)} + 6) // 7)"


def zz(x: str) -> str:
    """DuckDB: zigzag."""
    return f"(CASE WHEN ({x}) >= 0 THEN 2 * ({x}) ELSE -2 * ({x}) - 1 END)"


def packed(n: str, width: str) -> str:
    """DuckDB: bytes of n values of a width in bits."""
    return f"((({n}) * ({width}) + 7) // 8)"
