"""Query registration."""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        @functools.wraps(fn)
        def in_utc(spark: SparkSession, sf: str) -> DataFrame:
            # The tables hold times without a zone; every plan reads them as UTC.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf)

        QUERIES[name] = in_utc
        if sql is not None:
            TWINS[name] = sql
        return fn

    return register


def round_double(value: Column | str, places: int) -> Column:
    """Rounds a double as the SQL twins do: the scaled double goes to a whole number.

    Spark's own ``round`` works on the printed digits, so a share that prints as
    0.0001245 goes up where the scaled double lies just below the half.
    """
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    scale = F.lit(10.0**places)
    # A whole number is rounded right by either; a value too large to scale stays.
    return F.when(F.abs(x * scale) < float("inf"), F.round(x * scale, 0) / scale).otherwise(x)


def rounded(frame: DataFrame, places: int = 6, at: Mapping[str, int | None] | None = None) -> DataFrame:
    """Plain report types: doubles rounded (columns of ``at`` to places of their own, or
    not at all with None), small integers widened."""
    cells = []
    for f in frame.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            own = (at or {}).get(f.name, places)
            c = c.cast("double") if own is None else round_double(c, own)
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        cells.append(c.alias(f.name))
    return frame.select(*cells)


# Means of whole cents end in exact halves of the last printed digit; a nudge
# keeps the order of summation from deciding which way they round.
NUDGE = 1e-7


def mean_rounded(name: str, places: int = 4) -> Column:
    return round_double(F.col(name) + F.lit(NUDGE), places)


def mean_rounded_sql(expression: str, places: int = 4) -> str:
    return f"round({expression} + CAST({NUDGE!r} AS DOUBLE), {places})"
