"""Row-level expressions.  Each one is a plain ``Column``: no UDF, no shuffle,
and the same result for a row alone, in a batch or in a stream."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.settings import DRIFT, MISSING, SECONDS_PER_DAY, SECONDS_PER_HOUR, DriftRules


def to_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def usable(c: Column | str) -> Column:
    """The value as double, or null when it is null, NaN or infinite."""
    x = to_col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def nulls_for_nan(frame: DataFrame) -> DataFrame:
    """Keep one kind of missing: turn NaN into null in every float column."""
    return frame.select(
        *[
            F.when(~F.isnan(f.name), F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f"`{f.name}`")
            for f in frame.schema.fields
        ]
    )


def label_text(c: Column | str, dtype: T.DataType) -> Column:
    """Text used for counting and lookups: ``315`` gives ``315.0``, null gives
    ``(missing)``, text stays as it is.

    All numbers of one value print alike whatever their storage type.  The
    decimal detour avoids the exponent form that a double cast would print.
    """
    x = to_col(c)
    if isinstance(dtype, T.IntegralType):
        text = F.concat(x.cast("string"), F.lit(".0"))
    elif isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
        v = x.cast("double")
        fixed = F.rtrim(F.bround(v, 6).try_cast("decimal(38,6)").cast("string"), F.lit("0"))
        fixed = F.when(fixed.endswith("."), F.concat(fixed, F.lit("0"))).otherwise(fixed)
        text = F.when(F.isnan(v), None).otherwise(F.coalesce(fixed, v.cast("string")))
    else:
        text = x.cast("string")
    return F.coalesce(text, F.lit(MISSING))


def label_of(frame: DataFrame, name: str) -> Column:
    return label_text(F.col(name), frame.schema[name].dataType)


def join_labels(*labels: Column) -> Column:
    return F.concat_ws("_", *labels)


def hour_of(seconds: Column | str) -> Column:
    return F.pmod(F.floor(to_col(seconds) / SECONDS_PER_HOUR), F.lit(24))


def day_of_week(seconds: Column | str) -> Column:
    return F.pmod(day_number(seconds), F.lit(7))


def day_number(seconds: Column | str) -> Column:
    return F.floor(to_col(seconds) / SECONDS_PER_DAY)


def amount_cents(amount: Column | str) -> Column:
    a = to_col(amount).cast("double")
    return F.bround(a - F.floor(a), 4)


def amount_parts(amount: Column | str, prefix: str = "amount") -> list[Column]:
    cents = amount_cents(amount)
    return [
        F.log1p(to_col(amount).cast("double")).alias(f"{prefix}_log"),
        cents.alias(f"{prefix}_cents"),
        (cents == 0).cast("int").alias(f"{prefix}_is_round"),
    ]


def domain_parts(label: Column | str) -> tuple[Column, Column]:
    """``gmail.com`` gives ``gmail`` and ``com``; no dot gives ``(missing)``."""
    parts = F.split(to_col(label), r"\.", 2)
    return parts[0], F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(MISSING))


def dimension_parts(label: Column | str) -> tuple[Column, Column, Column]:
    """``1920x1080`` gives width, height and area; what does not parse is null."""
    parts = F.split(to_col(label), "x", 2)
    width = parts[0].try_cast("double")
    height = F.try_element_at(parts, F.lit(2)).try_cast("double")
    return width, height, width * height


def first_token(label: Column | str) -> Column:
    head = F.split_part(to_col(label), F.lit(" "), F.lit(1))
    return F.lower(F.split_part(head, F.lit("/"), F.lit(1)))


def _total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms, F.lit(0))


def match_counts(
    frame: DataFrame, columns: list[str], not_counted: tuple[str, ...] = ("M4",), truth: str = "T"
) -> tuple[Column, Column]:
    """How many of the columns hold ``truth`` and how many are null.

    Columns the frame lacks are skipped; those in ``not_counted`` only count
    as missing.
    """
    present = [c for c in columns if c in frame.columns]
    hits = [
        F.when(F.col(c).cast("string") == truth, 1).otherwise(0)
        for c in present
        if c not in not_counted
    ]
    blanks = [F.when(F.col(c).isNull(), 1).otherwise(0) for c in present]
    return _total(hits), _total(blanks)


def entity_key(frame: DataFrame, card: str, address: str, seconds: str, age_days: str) -> Column:
    """Fingerprint of one customer: card, address and the day the card was
    first seen.  For grouping and counting only, never a feature."""
    lacking = [c for c in (card, address, seconds, age_days) if c not in frame.columns]
    if lacking:
        raise KeyError(f"entity key needs columns {lacking}")
    first_day = day_number(seconds) - F.col(age_days).cast("double")
    return join_labels(
        label_of(frame, card), label_of(frame, address), label_text(first_day, T.DoubleType())
    )


def domains_match(left: Column | str, right: Column | str) -> Column:
    """1 or 0 when both are known, else null."""
    a, b = to_col(left), to_col(right)
    return F.when((a != MISSING) & (b != MISSING), (a == b).cast("double"))


def time_columns(seconds: Column | str, origin: str = "1970-01-01 00:00:00") -> list[Column]:
    """Readable time of a seconds counter that starts at ``origin``."""
    ts = F.timestamp_seconds(F.unix_timestamp(F.lit(origin)) + to_col(seconds))
    return [
        ts.alias("timestamp"),
        F.to_date(ts).alias("date"),
        F.hour(ts).alias("hour"),
        F.weekday(ts).alias("day_of_week"),
        day_number(seconds).alias("day_index"),
    ]


def iso_date(seconds: Column | str, origin: str = "1970-01-01 00:00:00") -> Column:
    ts = F.timestamp_seconds(F.unix_timestamp(F.lit(origin)) + to_col(seconds))
    return F.date_format(ts, "yyyy-MM-dd")


def week_label(ts: Column | str) -> Column:
    """``Monday/Sunday`` of the week."""
    start = F.to_date(F.date_trunc("week", to_col(ts)))
    return F.concat_ws(
        "/", F.date_format(start, "yyyy-MM-dd"), F.date_format(F.date_add(start, 6), "yyyy-MM-dd")
    )


def month_label(ts: Column | str) -> Column:
    return F.date_format(to_col(ts), "yyyy-MM")


def decision(score: Column | str, threshold: float) -> Column:
    return F.when(to_col(score) >= F.lit(threshold), "review").otherwise("pass")


def missing_fields(required: list[str]) -> Column:
    """Names of the required columns that are null in this row."""
    return F.filter(
        F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]), lambda n: n.isNotNull()
    )


def ratio_or_null(value: Column, base: Column) -> Column:
    return usable(F.try_divide(value, base))


def drift_band(psi: Column | str, rules: DriftRules = DRIFT) -> Column:
    p = usable(psi)
    return (
        F.when(p.isNull(), "unknown")
        .when(p < rules.stable, "stable")
        .when(p < rules.significant, "moderate")
        .otherwise("significant")
    )


def column_family(name: Column | str, exact: dict[str, str], rules: list[tuple[str, str]]) -> Column:
    """Family of a column name: exact names first, then anchored patterns."""
    n = to_col(name)
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for family in dict.fromkeys(exact.values()):
        chain = chain.when(n.isin([k for k, v in exact.items() if v == family]), family)
    for pattern, family in rules:
        chain = chain.when(n.rlike(pattern), family)
    return chain.otherwise("unmapped")
