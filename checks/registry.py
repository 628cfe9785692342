"""The register of queries and of the SQL each is compared to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.views import VIEWS, Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
# Steps of the comparison SQL that several comparisons share.
STEPS: dict[str, str] = {}
SCALE = 1e6


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals (half to even), negative zero as zero: both engines sum in their own order."""

    def column(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            return (F.rint(c * SCALE) / SCALE + 0.0).alias(f.name)
        return c

    return df.select(*[column(f) for f in df.schema.fields])


def query(name: str, sql: str | None = None, doubles: str = ""):
    """Register ``function(tables) -> DataFrame`` under a name, with its comparison SQL.

    ``doubles`` names the columns that both sides round.
    """

    def register(function: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: rounded(function(Tables(spark, folder)))
        if sql is not None:
            replaced = ", ".join(f"round_even({c} * 1e6, 0) / 1e6 + 0.0 AS {c}" for c in doubles.split())
            chosen = f"* REPLACE ({replaced})" if replaced else "*"
            # Assembled later, when every shared step is known.
            ORACLES[name] = f"SELECT {chosen} FROM ({sql}) result"
        return function

    return register


def oracles() -> dict[str, str]:
    return {name: with_views(sql, VIEWS | STEPS) for name, sql in ORACLES.items()}
