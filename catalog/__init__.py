"""Registered queries on the test tables, each with its SQL counterpart where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its inventory name, with the SQL that must give the same rows."""

    def keep(f: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round all floating-point columns, so that the order of additions does not show."""
    made = [
        F.round(F.col(f"`{f.name}`"), digits).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ]
    return df.select(*made)


def rounded(x: Column, digits: int) -> Column:
    """x rounded the way the SQL side does it: the nearest whole number of x times a power of ten.

    F.round goes by the shortest decimal form of x, so the two differ where x is a last bit away from a tie.
    """
    power = F.lit(10.0**digits)
    return F.round(x * power) / power


def load_all() -> None:
    from catalog import (  # noqa: F401
        aggregates,
        events,
        features,
        insights,
        modelling,
        profiling,
        scalars,
        segments,
        sources,
    )
