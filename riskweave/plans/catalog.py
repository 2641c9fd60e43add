"""Registry of named queries, each with an independent SQL statement over the same tables where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Comparable output: doubles to six decimals, whole numbers as bigint, times as microseconds."""
    out = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType.typeName()
        if t in ("double", "float") or t.startswith("decimal"):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif t in ("integer", "short", "byte", "long"):
            c = c.cast("bigint")
        elif t == "timestamp":
            c = F.unix_micros(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register ``fn`` under ``name``; ``sql`` is the statement its result must equal."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return tidy(fn(spark, folder))

        run.__name__ = run.__qualname__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
