"""Where queries over the test tables and their SQL twins are put together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without ``sql`` there is no twin in plain SQL."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is there already")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quote(text: str) -> str:
    """A SQL text literal."""
    return "'" + text.replace("'", "''") + "'"


def sql_uuid5(value: str) -> str:
    """SQL for the name-based UUID of an expression."""
    h = f"sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode({value}))"
    return (
        f"substr({h},1,8) || '-' || substr({h},9,4) || '-5' || substr({h},14,3) || '-' "
        f"|| translate(substr({h},17,1),'0123456789abcdef','89ab89ab89ab89ab') "
        f"|| substr({h},18,3) || '-' || substr({h},21,12)"
    )


def sql_squeeze(value: str) -> str:
    """SQL for squeezed white space."""
    return rf"trim(regexp_replace({value}, '[\s\x0B\x{{00A0}}]+', ' ', 'g'))"


def sql_list(values: list[str]) -> str:
    """A SQL list literal of texts."""
    return "[" + ", ".join(quote(v) for v in values) + "]"
