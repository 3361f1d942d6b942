"""Enrichment joins: contracts on keys, coverage, and skew-proof lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from txrisk.session import materialise
from txrisk.settings import SCALE, Scale


def assert_unique_key(frame: DataFrame, key: str, name: str) -> DataFrame:
    """Fail the query at the first repeated key.

    The check numbers the rows of a key, so it needs the frame partitioned by
    the key - as the join that follows does - and adds no shuffle of its own.
    """
    numbered = frame.withColumn("__nth", F.row_number().over(W.partitionBy(key).orderBy(key)))
    checked = F.assert_true(F.col("__nth") == 1, F.lit(f"{name}: key {key} is not unique"))
    return numbered.filter(checked.isNull()).drop("__nth")


def enrich_one_to_one(
    facts: DataFrame, side: DataFrame, key: str, flag: str, check: bool = True
) -> DataFrame:
    """Keep every fact row, attach its side row where there is one, and mark
    the match with 1 or 0.  Both keys must be unique.

    The mark is a constant of the side table, so a side row whose own fields
    are all null still counts as a match.
    """
    if check:
        facts = assert_unique_key(facts, key, "left side")
        side = assert_unique_key(side, key, "right side")
    joined = facts.join(side.withColumn(flag, F.lit(1)), key, "left")
    return joined.withColumn(flag, F.coalesce(flag, F.lit(0)))


def join_contract(
    merged: DataFrame, key: str, expected_rows: Column | int, expected_columns: int
) -> DataFrame:
    """Row count, column count and key uniqueness of a join result, all
    reported in one row instead of stopping at the first failure."""
    per_key = merged.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    facts = per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("actual_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_keys"),
    )
    wanted = F.lit(expected_rows) if isinstance(expected_rows, int) else expected_rows
    table = facts.select(
        "actual_rows",
        F.lit(len(merged.columns)).cast("long").alias("actual_columns"),
        wanted.cast("long").alias("expected_rows"),
        F.lit(expected_columns).cast("long").alias("expected_columns"),
        "duplicate_keys",
    )
    return table.select(
        "*",
        (F.col("actual_rows") == F.col("expected_rows")).alias("rows_match"),
        (F.col("actual_columns") == F.col("expected_columns")).alias("columns_match"),
        (F.col("duplicate_keys") == 0).alias("keys_unique"),
    ).withColumn("passed", F.col("rows_match") & F.col("columns_match") & F.col("keys_unique"))


def key_coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many left keys the right table covers: one shuffle per table."""
    return (
        left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r"))
        .unionByName(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
        .groupBy(key)
        .agg(F.max("l").alias("l"), F.max("r").alias("r"))
        .agg(
            F.sum("l").alias("left_keys"),
            F.sum("r").alias("right_keys"),
            F.sum(F.col("l") * F.col("r")).alias("shared_keys"),
        )
        .withColumn("coverage", F.try_divide(F.col("shared_keys"), F.col("left_keys")))
    )


def missing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def key_uniqueness(frame: DataFrame, key: str, table: str) -> DataFrame:
    per_key = frame.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.lit(table).alias("table_name"),
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("unique_keys"),
        F.sum(F.col("n") - 1).alias("duplicate_keys"),
    )


def broadcast_if_small(small: DataFrame, limit: int = 10_000) -> DataFrame:
    """Run a summary query once, write it, and hand it to every task if it has
    few rows; beyond ``limit`` rows the planner picks the join.  No row reaches
    the driver.
    """
    written = materialise(small, "summary")
    return F.broadcast(written) if written.count() <= limit else written


def row_bytes(key: str, columns: Sequence[str]) -> Column:
    """About the bytes of a lookup row in a broadcast: its label and 16 a number."""
    return F.coalesce(F.octet_length(F.col(key)), F.lit(0)).cast("long") + F.lit(16 * len(columns))


def lookup_size(lookup: DataFrame, key: str) -> tuple[int, int]:
    """Rows and bytes of a lookup table with a text key and numeric values."""
    size = lookup.agg(F.count(F.lit(1)), F.coalesce(F.sum(row_bytes(key, lookup.columns)), F.lit(0))).first()
    return size[0], size[1]


def lookup_join(
    frame: DataFrame,
    key: str,
    lookup: DataFrame,
    lookup_key: str,
    lookup_rows: int,
    share: str = "share",
    scale: Scale = SCALE,
    salt: str | None = None,
    lookup_bytes: int = 0,
) -> DataFrame:
    """Left join to a table of one row per label; unmatched labels give null.

    A table known to be small, in rows and in bytes, is broadcast.  A larger one is shuffled, but its
    frequent labels are not: those above ``hot_share`` number at most
    ``1/hot_share``, are served by a broadcast, and their fact rows are spread
    over all tasks by a key that matches nothing on the other side.  That key
    comes from the column ``salt`` alone (the first column by default: the id),
    so columns that the result does not need are not read for it.
    """
    values = [c for c in lookup.columns if c != lookup_key]
    named = lookup.withColumnRenamed(lookup_key, key)
    if lookup_rows <= scale.broadcast_rows and lookup_bytes <= scale.broadcast_bytes:
        return frame.join(F.broadcast(named), key, "left")

    hot = named.filter(F.col(share) >= scale.hot_share).select(
        key, F.struct(*values).alias("__hot")
    )
    cold = named.filter((F.col(share) < scale.hot_share) | F.col(share).isNull()).select(
        F.struct(F.lit(-1).alias("spread"), F.col(key).alias("label")).alias("__key"),
        F.struct(*values).alias("__cold"),
    )
    served = frame.join(F.broadcast(hot), key, "left")
    elsewhere = F.pmod(F.xxhash64(F.col(f"`{salt or frame.columns[0]}`")), F.lit(100_003))
    routed = served.withColumn(
        "__key",
        F.when(
            F.col("__hot").isNull(), F.struct(F.lit(-1).alias("spread"), F.col(key).alias("label"))
        ).otherwise(
            F.struct(elsewhere.cast("int").alias("spread"), F.lit("").alias("label"))
        ),
    )
    joined = routed.join(cold, "__key", "left")
    return joined.select(
        *frame.columns,
        *[F.coalesce(F.col(f"__hot.{v}"), F.col(f"__cold.{v}")).alias(v) for v in values],
    )


def lookup_many(
    frame: DataFrame, keys: dict[str, str], lookup: DataFrame, values: dict[str, Sequence[str]], scale: Scale = SCALE
) -> DataFrame:
    """Left joins of one frame to many large lookups, in one shuffle of labels.

    ``keys`` names the label column of each lookup; ``lookup`` holds them all as
    (column, label, share, ...), and ``values`` says what is wanted of each.
    Gives ``frame`` and a column ``value@column`` for each, null where the label
    is unknown.  Extra columns of the frame may have any other names.

    The frame is written once with a row number, its labels are stacked, joined
    on (column, label), put together again by row and joined back: the number of
    shuffles does not follow that of lookups.  Labels above ``hot_share``, at most
    ``1/hot_share`` a lookup, are served by a broadcast and are not shuffled.
    """
    wanted = sorted({v for names in values.values() for v in names})
    numbered = materialise(frame.withColumn("__row", F.monotonically_increasing_id()), "labelled")
    pairs = [F.struct(F.lit(c).alias("column"), F.col(f"`{k}`").alias("label")) for c, k in keys.items()]
    stacked = numbered.select("__row", F.inline(F.array(*pairs)))
    served = lookup.filter(F.col("column").isin(list(keys))).select("column", "label", "share", *[F.col(v).alias(f"__{v}") for v in wanted])
    frequent = F.coalesce(F.col("share") >= scale.hot_share, F.lit(False))
    hot, cold = served.filter(frequent).drop("share"), served.filter(~frequent).drop("share")
    on = ["column", "label"]
    known = stacked.join(F.broadcast(hot), on)
    others = stacked.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on)
    found = known.unionByName(others).groupBy("__row").agg(
        *[
            F.max(F.when(F.col("column") == c, F.col(f"__{v}"))).alias(f"{v}@{c}")
            for c, names in values.items()
            for v in names
        ]
    )
    return numbered.join(found, "__row", "left").drop("__row")


def union_tables(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
