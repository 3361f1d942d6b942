"""Choosing column types from the data without losing a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.settings import CATEGORY_DISTINCT_RATIO, FLOAT32_WHOLE_LIMIT, SKETCH_BITS, SKETCH_ERROR

_INT_LIMITS = [("tinyint", 2**7), ("smallint", 2**15), ("int", 2**31)]


def _int_type(lo: Column, hi: Column) -> Column:
    chain = F.when(lo.isNull(), "tinyint")
    for name, limit in _INT_LIMITS:
        chain = chain.when((lo >= -limit) & (hi < limit), name)
    return chain.otherwise("bigint")


def narrowing_plan(
    frame: DataFrame, pinned: dict[str, str] | None = None, errors: float = 5.0
) -> DataFrame:
    """One row per column: its type, the narrowest lossless type, and whether
    text repeats enough to be a category; null counts as a value.

    One aggregate over the table tells all of it, distinct texts from sketches
    of fixed size.  Only a text column whose distinct share lies within
    ``errors`` standard errors of the limit is counted by value; free text, far
    above it, is never shuffled.
    """
    pinned = pinned or {}
    aggs, cells, texts = [], [], []
    for i, f in enumerate(frame.schema.fields):
        c = F.col(f"`{f.name}`")
        kind = f.dataType
        if f.name in pinned:
            chosen = F.lit(pinned[f.name])
        elif isinstance(kind, T.IntegralType):
            aggs += [F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
            chosen = _int_type(F.col(f"lo{i}").cast("long"), F.col(f"hi{i}").cast("long"))
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            v = F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c.cast("double"))
            aggs += [
                F.bool_and(v == F.rint(v)).alias(f"whole{i}"),
                F.max(F.abs(v)).alias(f"top{i}"),
            ]
            unsafe = F.col(f"whole{i}") & (F.col(f"top{i}") >= FLOAT32_WHOLE_LIMIT)
            chosen = F.when(unsafe, kind.simpleString()).otherwise("float")
        else:
            chosen = F.lit(kind.simpleString())
            if isinstance(kind, T.StringType):
                texts.append(f.name)
                sketch = F.hll_sketch_estimate(F.hll_sketch_agg(c, F.lit(SKETCH_BITS)))
                aggs += [sketch.alias(f"d{i}"), F.max(c.isNull().cast("long")).alias(f"null{i}")]
        cells.append(
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(kind.simpleString()).alias("current_type"),
                chosen.alias("narrow_type"),
            )
        )
    row = frame.agg(F.count(F.lit(1)).alias("rows"), *aggs)
    place = {f.name: i for i, f in enumerate(frame.schema.fields)}
    extra = [F.col(f"{kind}{place[c]}") for c in texts for kind in ("d", "null")]
    # One row reaches the driver.
    found = row.select("rows", F.array(*cells).alias("cells"), *extra).first()
    limit, off = CATEGORY_DISTINCT_RATIO * found["rows"], errors * SKETCH_ERROR
    repeats, unsure = {}, []
    for c in texts:
        about, null = (found[f"{kind}{place[c]}"] or 0 for kind in ("d", "null"))
        repeats[c] = about / (1 - off) + null < limit
        if not repeats[c] and about / (1 + off) + null < limit:
            unsure.append(c)
    if unsure:
        distinct = (
            frame.select(*[f"`{c}`" for c in unsure])
            .unpivot([], unsure, "column", "value")
            .groupBy("column", "value")
            .agg(F.lit(1).alias("one"))
            .groupBy("column")
            .agg(F.count("one").alias("distinct_values"))
        )
        repeats |= {r["column"]: r["distinct_values"] < limit for r in distinct.collect()}
    return frame.sparkSession.createDataFrame(
        [(*cell, repeats.get(cell["column"], False)) for cell in found["cells"]],
        "column string, current_type string, narrow_type string, is_category boolean",
    )


def apply_narrowing(frame: DataFrame, plan: DataFrame) -> DataFrame:
    """Cast every column to its narrow type (one row per column is read)."""
    types = {r["column"]: r["narrow_type"] for r in plan.collect()}
    return frame.select(*[F.col(f"`{c}`").cast(types[c]).alias(c) for c in frame.columns])


def numeric_coercion_plan(frame: DataFrame, columns: list[str]) -> DataFrame:
    """A text column is numeric only if every non-null value is a number."""
    lost = [
        F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).alias(c)
        for c in columns
    ]
    return (
        frame.agg(*lost)
        .unpivot([], columns, "column", "values_lost")
        .select(
            "column",
            "values_lost",
            F.when(F.col("values_lost") == 0, "double").otherwise("string").alias("target_type"),
        )
    )
