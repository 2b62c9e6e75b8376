"""Named queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.derived import oracle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        key = name or function.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = function
        if sql:
            ORACLES[key] = oracle(sql)
        return function

    return add


def milli(c: Column, scale: int = 1000) -> Column:
    """A double as a whole number of thousandths, so the last bits of logarithms do not show."""
    return F.floor(c * scale + 0.5).cast("long")


def milli_sql(c: str, scale: int = 1000) -> str:
    return f"cast(floor(({c}) * {scale} + 0.5) as bigint)"


def real(v: float) -> str:
    return f"cast('{v!r}' as double)"


def at_zooms(df: DataFrame, *zooms: int) -> DataFrame:
    return df.withColumn("z", F.explode(F.array(*(F.lit(z) for z in zooms))))


def zooms_sql(*zooms: int) -> str:
    return f"(values {', '.join(f'({z})' for z in zooms)}) zs(z)"
