"""Choosing columns: constant, near-constant with rescue, redundant in a block."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from txrisk.operators.profile import stacked_values, value_counts_long
from txrisk.session import materialise
from txrisk.settings import (
    BLOCK_CORRELATION,
    NEAR_CONSTANT_SHARE,
    RESCUE_MIN_LIFT,
    RESCUE_MIN_ROWS,
    SCALE,
    Scale,
)

# A column is taken as flat when more than one in so many of its buckets are
# half as full as the fullest; it only decides what is counted first.
FLAT_PART = 10


def constant_columns(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns with at most one distinct non-null value: the least equals the
    greatest, so no distinct count is needed."""
    aggs, cells = [], []
    for i, name in enumerate(columns):
        c = F.col(f"`{name}`")
        aggs.append(F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias(f"k{i}"))
        cells.append(F.struct(F.lit(name).alias("column"), F.col(f"k{i}").alias("is_constant")))
    return (
        frame.agg(*aggs).select(F.inline(F.array(*cells))).filter("is_constant").select("column")
    )


def dominant_value(counts: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """Most frequent value per column, null included, the lowest value on ties
    (null before text); ``carried`` sums ride along for the whole column and
    for the dominant value.

    Input is one row per (column, value).  The reduction is an aggregate, so a
    column with very many values is combined map-side.
    """
    found = counts.groupBy("column").agg(
        F.min_by(
            F.struct(F.col("value"), F.col("n"), *[F.col(c) for c in carried]),
            F.struct(-F.col("n"), F.col("value").isNotNull(), F.col("value")),
        ).alias("d"),
        F.sum("n").alias("rows"),
        F.count("value").alias("distinct_values"),
        *[F.sum(c).alias(f"{c}_rows") for c in carried],
    )
    return found.select(
        "column",
        F.col("d.value").alias("dominant_value"),
        F.try_divide(F.col("d.n"), F.col("rows")).alias("dominant_share"),
        "rows",
        F.col("d.n").alias("dominant_rows"),
        "distinct_values",
        *[F.col(f"{c}_rows") for c in carried],
        *[F.col(f"d.{c}").alias(f"{c}_dominant") for c in carried],
    )


def dominant_by_bounds(
    frame: DataFrame, columns: Sequence[str], carried: Sequence[str] = (), scale: Scale = SCALE
) -> DataFrame:
    """``dominant_value`` over all values of ``columns``, plus ``is_constant`` (at
    most one distinct non-null value); ``carried`` columns of numbers are summed.

    Values are counted by hash bucket first: a sketch of fixed size that tasks
    merge.  A bucket's rows bound the rows of every value in it, so only the
    values of a column's fullest buckets are counted one by one, then those of
    buckets that hold as many rows as the best value found.  Values of other
    buckets are never shuffled; a column in which nothing is frequent (an id)
    has no fuller bucket than others and is counted whole.  The result is exact.

    The frame is read two or three times, so it must give the same rows again.
    """
    buckets = max(16, min(scale.value_buckets, scale.broadcast_rows // max(1, len(columns))))
    # Null is a value of its own, in a bucket of its own.
    place = F.when(F.col("value").isNull(), -1).otherwise(F.pmod(F.xxhash64("value"), F.lit(buckets)))
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in carried]]

    def placed(names: Sequence[str]) -> list[DataFrame]:
        parts = stacked_values(frame.select(*carried, *names), names, scale)
        return [p.withColumn("bucket", place) for p in parts]

    def counted(names: Sequence[str], wanted: DataFrame) -> DataFrame:
        # At most columns x buckets rows are broadcast: no more than ``broadcast_rows``.
        parts = [
            p.join(F.broadcast(wanted), ["column", "bucket"], "left_semi").groupBy("column", "value").agg(*sums)
            for p in placed(names)
        ]
        return reduce(DataFrame.unionByName, parts)

    parts = [p.groupBy("column", "bucket").agg(*sums) for p in placed(columns)]
    column, filled = W.partitionBy("column"), F.col("bucket") >= 0
    fullest = F.max("n").over(column)
    near = F.col("n") * 2 >= F.col("fullest")
    sizes = (
        materialise(reduce(DataFrame.unionByName, parts), "buckets")
        .withColumns({"fullest": fullest, "filled": F.count_if(filled).over(column)})
        .withColumn("flat", F.count_if(near).over(column) * FLAT_PART > F.count(F.lit(1)).over(column))
        # The only bucket with values tells whether the column is constant.
        .withColumn("first", (F.col("n") == F.col("fullest")) | F.col("flat") | (filled & (F.col("filled") == 1)))
    )
    # One row per column comes to the driver, here and below.
    totals = sizes.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.first("filled").alias("filled"),
        F.coalesce(F.max(F.when(~F.col("first"), F.col("n"))), F.lit(0)).alias("left"),
        *[F.sum(c).alias(f"{c}_rows") for c in carried],
    ).collect()
    names = ["column", "dominant_value", "dominant_rows", "distinct_values", *[f"{c}_dominant" for c in carried]]
    first = counted(columns, sizes.filter("first").select("column", "bucket"))
    best = {r["column"]: r for r in dominant_value(first, carried).select(*names).collect()}
    values = {c: r["distinct_values"] for c, r in best.items()}
    spark = frame.sparkSession
    left = [r["column"] for r in totals if r["left"] >= best[r["column"]]["dominant_rows"]]
    if left:
        bar = spark.createDataFrame([(c, best[c]["dominant_rows"]) for c in left], "column string, bar long")
        wanted = sizes.join(F.broadcast(bar), "column").filter(~F.col("first") & (F.col("n") >= F.col("bar")))
        more = counted([c for c in columns if c in set(left)], wanted.select("column", "bucket"))
        rank = lambda r: (-r["dominant_rows"], r["dominant_value"] is not None, r["dominant_value"])
        for r in dominant_value(more, carried).select(*names).collect():
            best[r["column"]] = min(best[r["column"]], r, key=rank)

    rows = []
    for r in totals:
        top = best[r["column"]]
        constant = r["filled"] == 0 or (r["filled"] == 1 and values[r["column"]] <= 1)
        share = top["dominant_rows"] / r["rows"]
        sides = [r[f"{c}_rows"] for c in carried] + [top[f"{c}_dominant"] for c in carried]
        rows.append((r["column"], top["dominant_value"], share, r["rows"], top["dominant_rows"], constant, *sides))
    sides = [f"{c}_rows long" for c in carried] + [f"{c}_dominant long" for c in carried]
    return spark.createDataFrame(
        rows,
        ", ".join(
            ["column string, dominant_value string, dominant_share double, rows long", "dominant_rows long", "is_constant boolean", *sides]
        ),
    )


def near_constant_rescue(
    frame: DataFrame,
    label: str,
    columns: Sequence[str],
    *,
    threshold: float = NEAR_CONSTANT_SHARE,
    min_rare_rows: int = RESCUE_MIN_ROWS,
    min_lift: float = RESCUE_MIN_LIFT,
    scale: Scale = SCALE,
) -> DataFrame:
    """Judge each column: keep it unless one value covers ``threshold`` of the
    rows - and even then keep it when enough other rows exist whose positive
    rate is ``min_lift`` times the overall one, or its inverse.

    Rule and rescue read the same counts, those of ``dominant_by_bounds``.
    """
    judged = judge_columns(
        frame,
        label,
        columns,
        threshold=threshold,
        min_rare_rows=min_rare_rows,
        min_lift=min_lift,
        scale=scale,
    )
    return judged.drop("rows", "is_constant")


def judge_columns(
    frame: DataFrame,
    label: str,
    columns: Sequence[str],
    *,
    threshold: float = NEAR_CONSTANT_SHARE,
    min_rare_rows: int = RESCUE_MIN_ROWS,
    min_lift: float = RESCUE_MIN_LIFT,
    scale: Scale = SCALE,
) -> DataFrame:
    """The near-constant verdict with the table's rows and whether the column
    is constant, which the same counts give."""
    work = frame.select(*columns, F.col(label).cast("long").alias("__y"))
    judged = dominant_by_bounds(work, list(columns), ["__y"], scale)
    rare = F.col("rows") - F.col("dominant_rows")
    rare_rate = F.try_divide(F.col("__y_rows") - F.col("__y_dominant"), rare)
    lift = F.coalesce(
        F.try_divide(rare_rate, F.try_divide(F.col("__y_rows"), F.col("rows"))), F.lit(0.0)
    )
    near = F.col("dominant_share") >= threshold
    measured = near & (rare >= min_rare_rows)
    rescued = (lift >= min_lift) | (lift <= 1 / min_lift)
    # The reasons are compared with reports made elsewhere.
    return judged.select(
        "column",
        "dominant_value",
        F.bround("dominant_share", 5).alias("dominant_share"),
        rare.alias("rare_rows"),
        F.when(measured, F.bround(rare_rate, 5)).alias("rare_rate"),
        F.when(measured, F.bround(lift, 3)).alias("lift"),
        F.when(~near | (measured & rescued), "keep").otherwise("drop").alias("decision"),
        F.when(~near, "not near-constant")
        .when(~measured, F.format_string("near-constant, only %d rare rows", rare))
        .when(rescued, "rescued: rare values linked to the label")
        .otherwise("near-constant, rare values unremarkable")
        .alias("reason"),
        "rows",
        "is_constant",
    )


def correlation_matrix(rows: DataFrame, columns: Sequence[str]) -> list[list[float]]:
    """Pearson matrix of complete rows; NaN where a column does not vary.

    One distributed pass; the result has columns x columns cells.
    """
    vectors = VectorAssembler(inputCols=list(columns), outputCol="__v").transform(
        rows.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    )
    return Correlation.corr(vectors.select("__v"), "__v").first()[0].toArray().tolist()


def block_correlation(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_a, column_b, r) for the pairs of a block, over the rows in which
    the whole block is present."""
    complete = frame.select(*columns).na.drop(subset=list(columns))
    matrix = correlation_matrix(complete, columns)
    rows = [
        (a, b, None if matrix[i][j] != matrix[i][j] else float(matrix[i][j]))
        for i, a in enumerate(columns)
        for j, b in enumerate(columns)
        if i < j
    ]
    return frame.sparkSession.createDataFrame(rows, "column_a string, column_b string, r double")


def greedy_clusters(matrix: list[list[float]], threshold: float) -> list[list[int]]:
    """Open a cluster at the first free column and pull in every free column
    that correlates with it; NaN never does."""
    free = list(range(len(matrix)))
    clusters = []
    while free:
        head = free[0]
        members = [head] + [j for j in free[1:] if abs(matrix[head][j]) >= threshold]
        clusters.append(members)
        free = [j for j in free if j not in members]
    return clusters


def _complete(block: Sequence[str]) -> Column:
    """Whether a row has a number in every column of a block; NaN is none."""
    return reduce(lambda a, b: a & b, [F.col(f"`{c}`").cast("double").isNotNull() & ~F.isnan(F.col(f"`{c}`").cast("double")) for c in block])


def block_reduce(
    frame: DataFrame,
    blocks: Sequence[Sequence[str]],
    threshold: float = BLOCK_CORRELATION,
    scale: Scale = SCALE,
) -> tuple[list[str], DataFrame]:
    """Keep one column per correlated cluster of each block: the one with the
    most distinct values, the earlier on ties.

    Returns the kept columns and the evidence table.  One pass counts the
    values of all blocks, each over its complete rows; then every block with
    something to compare costs one pass for its small matrix (tens of blocks).
    """
    found = [[c for c in block if c in frame.columns] for block in blocks]
    compared = [b for b in found if len(b) > 1]
    distinct: dict[str, int] = {}
    rows: dict[str, int] = {}
    if compared:
        masked = []
        for block in compared:
            masked += [F.when(_complete(block), F.col(c)).alias(c) for c in block]
        names = [c for b in compared for c in b]
        per_column = (
            value_counts_long(frame.select(*masked), names, scale=scale)
            .filter("value IS NOT NULL")
            .groupBy("column")
            .agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("rows"))
        )
        for r in per_column.collect():
            distinct[r["column"]], rows[r["column"]] = r["values"], r["rows"]

    kept: list[str] = []
    evidence = []
    for number, present in enumerate(found, start=1):
        if not present:
            continue
        if rows.get(present[0], 0) < 2:
            # a single column, or nothing to correlate: the first one stays
            clusters = [list(range(len(present)))]
        else:
            complete = frame.select(*present).filter(_complete(present))
            clusters = greedy_clusters(correlation_matrix(complete, present), threshold)
        for place, members in enumerate(clusters, start=1):
            names = [present[i] for i in members]
            chosen = max(names, key=lambda c: (distinct.get(c, 0), -names.index(c)))
            kept.append(chosen)
            evidence.append((number, place, chosen, len(names), ", ".join(names)))
    table = frame.sparkSession.createDataFrame(
        evidence,
        "block long, cluster long, kept_column string, n_represented long, represents string",
    )
    return kept, table
