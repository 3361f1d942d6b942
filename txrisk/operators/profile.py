"""Describing a table: balance, rates, columns, missing-value patterns, time."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.functions.scalar import column_family
from txrisk.operators.joins import broadcast_if_small
from txrisk.operators.ordering import exact_quantiles
from txrisk.settings import (
    MIN_CATEGORY_ROWS,
    MISSING,
    SCALE,
    SECONDS_PER_DAY,
    SKETCH_BITS,
    SKETCH_ERROR,
    Scale,
)

# Families by exact name and by anchored pattern.
FAMILY_NAMES = {
    "TransactionID": "identifier",
    "isFraud": "target",
    "TransactionDT": "time",
    "TransactionAmt": "amount",
    "ProductCD": "product",
    "has_identity": "engineered",
    "addr1": "address",
    "addr2": "address",
    "dist1": "distance",
    "dist2": "distance",
    "DeviceType": "device",
    "DeviceInfo": "device",
}
FAMILY_PATTERNS = [
    (r"_emaildomain$", "email"),
    (r"^card\d$", "card"),
    (r"^C\d{1,2}$", "counting_C"),
    (r"^D\d{1,2}$", "timedelta_D"),
    (r"^M\d$", "match_M"),
    (r"^V\d{1,3}$", "vesta_V"),
    (r"^id_\d{2}$", "identity_id"),
]


def _rate(positives: Column, rows: Column) -> Column:
    return F.try_divide(positives, rows)


def class_balance(frame: DataFrame, label: str) -> DataFrame:
    counted = frame.agg(F.count(F.lit(1)).alias("total"), F.sum(label).cast("long").alias("positives"))
    rest = F.col("total") - F.col("positives")
    return counted.select(
        "total",
        "positives",
        rest.alias("negatives"),
        _rate(F.col("positives"), F.col("total")).alias("positive_rate"),
        F.try_divide(rest, F.col("positives")).alias("ratio"),
    )


def rate_by_flag(frame: DataFrame, flag: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Rates with and without the flag and the lift between them; with ``by``
    the same inside each stratum in which the flag takes both values."""
    on = F.col(flag) == 1
    grouped = frame.groupBy(*by).agg(
        F.count_if(~on).alias("rows_without"),
        F.coalesce(F.sum(F.when(~on, F.col(label))), F.lit(0)).cast("long").alias("positives_without"),
        F.count_if(on).alias("rows_with"),
        F.coalesce(F.sum(F.when(on, F.col(label))), F.lit(0)).cast("long").alias("positives_with"),
    )
    if by:
        grouped = grouped.filter((F.col("rows_with") > 0) & (F.col("rows_without") > 0))
    without = _rate(F.col("positives_without"), F.col("rows_without"))
    with_ = _rate(F.col("positives_with"), F.col("rows_with"))
    return grouped.select(
        "*",
        without.alias("rate_without"),
        with_.alias("rate_with"),
        F.try_divide(with_, without).alias("lift"),
    )


def crosstab_share(frame: DataFrame, row: str, flag: str) -> DataFrame:
    """Share of each flag value per row category, in percent."""
    on = F.count_if(F.col(flag) == 1)
    rows = F.count(F.lit(1))
    return frame.groupBy(row).agg(
        F.bround((rows - on) / rows * 100, 1).alias("share_0"),
        F.bround(on / rows * 100, 1).alias("share_1"),
    )


def rate_by_category(
    frame: DataFrame,
    category: str,
    label: str,
    min_rows: int = MIN_CATEGORY_ROWS,
    top: int | None = None,
) -> DataFrame:
    """Positive rate per category, null being one, rarer categories left out."""
    named = F.coalesce(F.col(category).cast("string"), F.lit(MISSING)).alias("category")
    rated = (
        frame.select(named, F.col(label).alias("y"))
        .groupBy("category")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("y").cast("long").alias("positives"))
        .filter(F.col("rows") >= min_rows)
        .withColumn("rate", _rate(F.col("positives"), F.col("rows")))
        .orderBy(F.desc("rate"), "category")
    )
    return rated.limit(top) if top is not None else rated


def time_range(tables: dict[str, DataFrame], seconds: str) -> DataFrame:
    """Span of each table, and its gap in days to the end of the one before."""
    parts = [
        t.agg(F.min(seconds).alias("min_seconds"), F.max(seconds).alias("max_seconds")).select(
            F.lit(name).alias("label"), "min_seconds", "max_seconds"
        )
        for name, t in tables.items()
    ]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    previous_end = F.lag("max_seconds").over(W.orderBy("min_seconds", "label"))
    day = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd")
    return stacked.select(
        "*",
        F.bround((F.col("max_seconds") - F.col("min_seconds")) / SECONDS_PER_DAY, 1).alias("span_days"),
        day("min_seconds").alias("start_date"),
        day("max_seconds").alias("end_date"),
        F.bround((F.col("min_seconds") - previous_end) / SECONDS_PER_DAY, 1).alias("gap_days"),
    )


def _value_text(frame: DataFrame, name: str) -> Column:
    """Text that is equal for equal values (adding zero folds -0.0 into 0.0)."""
    c = F.col(f"`{name}`")
    if isinstance(frame.schema[name].dataType, (T.DoubleType, T.FloatType)):
        c = c + F.lit(0.0)
    return c.cast("string")


def stacked_values(frame: DataFrame, columns: Sequence[str], scale: Scale = SCALE) -> list[DataFrame]:
    """(other columns, column, value) over all columns, a chunk of columns a frame."""
    others = [c for c in frame.columns if c not in set(columns)]
    parts = []
    for i in range(0, len(columns), scale.unpivot_columns):
        chunk = list(columns[i : i + scale.unpivot_columns])
        texts = frame.select(*others, *[_value_text(frame, c).alias(c) for c in chunk])
        parts.append(texts.unpivot(others, chunk, "column", "value"))
    return parts


def value_counts_long(
    frame: DataFrame, columns: Sequence[str], extra: Sequence[Column] = (), scale: Scale = SCALE
) -> DataFrame:
    """(column, value, n, ...) over all columns, null counted as a value.

    Columns are stacked a chunk at a time, and each chunk is pre-aggregated in
    its own tasks, so the stacked rows never travel.
    """
    aggregated = [F.count(F.lit(1)).alias("n"), *extra]
    parts = [p.groupBy("column", "value").agg(*aggregated) for p in stacked_values(frame, columns, scale)]
    return reduce(DataFrame.unionByName, parts)


def distinct_sketches(frame: DataFrame, columns: Sequence[str], part: Column | None = None) -> DataFrame:
    """(part, column, rows, sketch): a distinct-count sketch of fixed size per
    column and part (a day, a file, a load), to be stored and merged later.

    No value is shuffled.  A null part is a part; ``rows`` counts non-null values,
    a column of nulls has an empty sketch, and -0.0 equals 0.0.
    """
    aggs, cells = [], []
    for i, name in enumerate(columns):
        aggs += [F.count(F.col(f"`{name}`")).alias(f"n{i}"), value_sketch(frame, name).alias(f"s{i}")]
        cells.append(F.struct(F.lit(name).alias("column"), F.col(f"n{i}").alias("rows"), F.col(f"s{i}").alias("sketch")))
    label = F.lit(None).cast("string") if part is None else part.cast("string")
    return frame.groupBy(label.alias("part")).agg(*aggs).select("part", F.inline(F.array(*cells)))


def value_sketch(frame: DataFrame, name: str) -> Column:
    return F.hll_sketch_agg(_value_text(frame, name), F.lit(SKETCH_BITS))


def merged_distinct(sketches: DataFrame, errors: float = 3.0) -> DataFrame:
    """Distinct values of each column over all parts of ``distinct_sketches``, with
    the bounds that ``errors`` standard errors give (99.7% at three)."""
    off = errors * SKETCH_ERROR
    merged = sketches.groupBy("column").agg(
        F.count(F.lit(1)).alias("parts"),
        F.sum("rows").alias("rows"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("unique_estimate"),
    )
    # An estimate is off by a share of the true count, which is at most ``rows``.
    low = F.floor(F.col("unique_estimate") / (1 + off))
    high = F.least(F.ceil(F.col("unique_estimate") / (1 - off)), F.col("rows"))
    return merged.withColumns({"unique_low": F.least(low, F.col("rows")), "unique_high": high})


def column_profile(
    frame: DataFrame,
    families: dict[str, str] | None = None,
    patterns: Sequence[tuple[str, str]] | None = None,
    scale: Scale = SCALE,
    approximate_distinct: bool = False,
    exact_distinct: Sequence[str] | None = None,
) -> DataFrame:
    """One row per column: family, type, missing count and share, distinct
    non-null values, and the range of numbers.

    Counts and ranges come from one aggregate; exact distinct counts from one
    shuffle of pre-aggregated (column, value) pairs.  ``approximate_distinct``
    takes distinct counts from sketches in that aggregate instead, but for the
    columns named in ``exact_distinct``; no value of other columns is shuffled.
    """
    exact = list(exact_distinct or []) if approximate_distinct else frame.columns
    aggs, cells = [], []
    for i, f in enumerate(frame.schema.fields):
        c = F.col(f"`{f.name}`")
        numeric = isinstance(f.dataType, T.NumericType)
        aggs.append(F.count(c).alias(f"n{i}"))
        if numeric:
            aggs += [F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
        sketched = f.name not in exact
        if sketched:
            aggs.append(F.hll_sketch_estimate(value_sketch(frame, f.name)).alias(f"d{i}"))
        cells.append(
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
                (F.col("rows") - F.col(f"n{i}")).alias("missing_count"),
                (F.col(f"lo{i}") if numeric else F.lit(None)).cast("double").alias("min_value"),
                (F.col(f"hi{i}") if numeric else F.lit(None)).cast("double").alias("max_value"),
                (F.col(f"d{i}") if sketched else F.lit(None))
                .cast("long")
                .alias("unique_count"),
            )
        )
    row = frame.agg(F.count(F.lit(1)).alias("rows"), *aggs)
    profile = row.select("rows", F.inline(F.array(*cells)))
    if exact:
        distinct = (
            value_counts_long(frame.select(*[f"`{c}`" for c in exact]), exact, scale=scale)
            .groupBy("column")
            .agg(F.count("value").alias("counted"))
        )
        profile = profile.join(distinct, "column", "left").withColumn(
            "unique_count", F.coalesce("counted", "unique_count")
        )
    family = column_family(
        "column",
        FAMILY_NAMES if families is None else families,
        list(FAMILY_PATTERNS if patterns is None else patterns),
    )
    return profile.select(
        "column",
        family.alias("family"),
        "dtype",
        "missing_count",
        F.bround(F.try_divide(F.col("missing_count") * 100.0, F.col("rows")), 2).alias("missing_pct"),
        F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
        "min_value",
        "max_value",
    ).orderBy("family", "column")


def missing_profile(profile: DataFrame, top: int = 25) -> DataFrame:
    """The emptiest columns, with how many are complete and nearly empty."""
    table = W.partitionBy()  # one row per column
    return (
        profile.select(
            "column",
            "family",
            "missing_pct",
            F.count_if(F.col("missing_pct") == 0).over(table).alias("columns_complete"),
            F.count_if(F.col("missing_pct") > 90).over(table).alias("columns_nearly_empty"),
        )
        .orderBy(F.desc("missing_pct"), "column")
        .limit(top)
    )


def family_summary(profile: DataFrame) -> DataFrame:
    return (
        profile.groupBy("family")
        .agg(
            F.count(F.lit(1)).alias("columns"),
            F.bround(F.avg("missing_pct"), 2).alias("mean_missing_pct"),
            F.bround(F.max("missing_pct"), 2).alias("max_missing_pct"),
        )
        .orderBy(F.desc("columns"), "family")
    )


def null_pattern_blocks(frame: DataFrame, row_id: str, columns: Sequence[str]) -> DataFrame:
    """Columns that are null on exactly the same rows, largest block first.

    Each column gets a fingerprint of the set of its null rows: their number
    and two independent order-free hashes of their ids (which must be unique).
    It is one aggregate over the table; only fingerprints are compared.
    """
    first = F.xxhash64(F.col(row_id))
    second = F.xxhash64(F.lit("second"), F.col(row_id))
    aggs, cells = [], []
    for i, name in enumerate(columns):
        gone = F.col(f"`{name}`").isNull()
        aggs += [
            F.count_if(gone).alias(f"n{i}"),
            F.bit_xor(F.when(gone, first).otherwise(0)).alias(f"a{i}"),
            F.bit_xor(F.when(gone, second).otherwise(0)).alias(f"b{i}"),
        ]
        cells.append(
            F.struct(
                F.lit(i).alias("place"),
                F.lit(name).alias("name"),
                F.col(f"n{i}").alias("nulls"),
                F.col(f"a{i}").alias("a"),
                F.col(f"b{i}").alias("b"),
            )
        )
    prints = frame.agg(F.count(F.lit(1)).alias("rows"), *aggs).select(
        "rows", F.inline(F.array(*cells))
    )
    members = F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda s: s["name"])
    blocks = prints.groupBy("rows", "nulls", "a", "b").agg(
        F.count(F.lit(1)).alias("n_columns"), F.min("place").alias("place"), members.alias("members")
    )
    return blocks.select(
        F.row_number().over(W.orderBy(F.desc("n_columns"), "place")).cast("long").alias("group_id"),
        "n_columns",
        F.bround(F.try_divide(F.col("nulls") * 100.0, F.col("rows")), 2).alias("missing_pct"),
        F.array_join("members", ", ").alias("columns"),
    )


def daily_volume(frame: DataFrame, ts: str) -> DataFrame:
    return (
        frame.groupBy(F.date_format(ts, "yyyy-MM-dd").alias("day"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .orderBy("day")
    )


def daily_rate(frame: DataFrame, ts: str, label: str) -> DataFrame:
    """Daily rate beside the overall one (which is a sum of the daily counts)."""
    daily = frame.groupBy(F.date_format(ts, "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(label).cast("long").alias("positives")
    )
    table = W.partitionBy()  # one row per day
    overall = F.try_divide(F.sum("positives").over(table), F.sum("rows").over(table))
    return daily.select(
        "*", _rate(F.col("positives"), F.col("rows")).alias("rate"), overall.alias("overall_rate")
    ).orderBy("day")


def hourly_rate(frame: DataFrame, ts: str, label: str) -> DataFrame:
    return (
        frame.groupBy(F.hour(ts).cast("long").alias("hour"))
        .agg(F.count(F.lit(1)).alias("rows"), F.sum(label).cast("long").alias("positives"))
        .withColumn("rate", _rate(F.col("positives"), F.col("rows")))
        .orderBy("hour")
    )


def log_amount(amount: str) -> Column:
    return F.log10(F.greatest(F.col(amount), F.lit(0.01)))


def density_histogram(
    frame: DataFrame,
    value: Column,
    group: str,
    bins: int,
    span: tuple[float, float] | None = None,
) -> DataFrame:
    """Histogram per group with equal bins and density heights (area 1).

    Each group spans its own minimum to maximum unless ``span`` fixes it; the
    top edge belongs to the last bin.
    """
    work = frame.select(F.col(group).alias("group"), value.alias("x")).filter("x is not null")
    if span is None:
        ends = work.groupBy("group").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
        work = work.join(broadcast_if_small(ends), "group")
    else:
        lo, hi = span
        work = work.filter(F.col("x").between(lo, hi)).select(
            "*", F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")
        )
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.least(F.floor(F.try_divide(F.col("x") - F.col("lo"), width)) + 1, F.lit(bins))
    counted = (
        work.select("group", "lo", width.alias("width"), F.coalesce(place, F.lit(1)).alias("bin"))
        .groupBy("group", "lo", "width", "bin")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    total = F.sum("rows").over(W.partitionBy("group"))
    return counted.select(
        "group",
        F.col("bin").cast("long").alias("bin"),
        (F.col("lo") + (F.col("bin") - 1) * F.col("width")).alias("edge"),
        "rows",
        F.try_divide(F.col("rows"), total * F.col("width")).alias("density"),
    )


def box_stats(frame: DataFrame, value: Column, group: str, scale: Scale = SCALE) -> DataFrame:
    """Quartiles per group, and whiskers at the last values within 1.5 IQR."""
    work = frame.select(F.col(group).alias("group"), value.alias("x"))
    found = exact_quantiles(work, ["x"], [0.25, 0.5, 0.75], by="group", scale=scale)
    rows = [(g, *q) for (g, _), q in found.items() if q]
    schema = f"group {work.schema['group'].dataType.simpleString()}, q1 double, median double, q3 double"
    quartiles = broadcast_if_small(frame.sparkSession.createDataFrame(rows, schema))
    reach = (F.col("q3") - F.col("q1")) * 1.5
    return (
        work.join(quartiles, "group")
        .filter(F.col("x").between(F.col("q1") - reach, F.col("q3") + reach))
        .groupBy("group", "q1", "median", "q3")
        .agg(F.min("x").alias("whisker_low"), F.max("x").alias("whisker_high"))
    )
