"""Global-order building blocks that never put the whole order in one task.

``prefix_sums`` cuts the sort key into ranges, writes them, sums inside each range and
adds the total of the ranges before it.  ``exact_quantiles`` brackets each
quantile with a sketch and then counts exactly, so only the rows near the
answer are shuffled.  A recomputed partition gives the same rows the same range.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from txrisk.functions.scalar import usable
from txrisk.session import materialise
from txrisk.settings import SCALE, Scale

_INF = float("inf")


def after(v: float) -> float:
    return math.nextafter(v, _INF)


def value_ranges(frame: DataFrame, column: str, splits: Sequence[float], out: str) -> DataFrame:
    """Number the range ``[s_i, s_i+1)`` each value falls in (binary search in
    the JVM).  ``splits`` are inner edges; the outer ones are open."""
    inner = sorted({float(s) for s in splits if math.isfinite(s)})
    if not inner:
        return frame.withColumn(out, F.lit(0))
    cut = Bucketizer(
        splits=[-_INF, *inner, _INF], inputCol=column, outputCol=out, handleInvalid="keep"
    )
    return cut.transform(frame).withColumn(out, F.col(out).cast("int"))


def many_value_ranges(
    frame: DataFrame, splits: Mapping[str, Sequence[float]], outs: Mapping[str, str]
) -> DataFrame:
    """``value_ranges`` for many columns in one projection."""
    inner = {c: sorted({float(s) for s in v if math.isfinite(s)}) for c, v in splits.items()}
    cut = [c for c in inner if inner[c]]
    if cut:
        frame = Bucketizer(
            splitsArray=[[-_INF, *inner[c], _INF] for c in cut],
            inputCols=cut,
            outputCols=[outs[c] for c in cut],
            handleInvalid="keep",
        ).transform(frame)
    return frame.withColumns(
        {outs[c]: F.col(outs[c]).cast("int") if c in cut else F.lit(0) for c in inner}
    )


def approximate_cuts(value: Column, parts: int) -> Column:
    """About equal cuts of a column into ``parts``."""
    # As text: one call to the JVM instead of one per probability.
    probs = ", ".join(f"{i / parts}D" for i in range(1, parts))
    return F.percentile_approx(value, F.expr(f"array({probs})"), F.lit(max(1000, 4 * parts)))


def count_sortable(frame: DataFrame, value: str) -> int:
    """Number of rows; an error if any has no value to sort by."""
    stats = frame.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(value).isNull() | F.isnan(value)).alias("bad"),
    ).first()
    if stats["bad"]:
        raise ValueError(f"{stats['bad']} rows have no value in the sort column {value!r}")
    return stats["n"]


def _range_frame(frame: DataFrame, order: Sequence[Column], out: str, rows: int, scale: Scale) -> DataFrame | None:
    """Number ranges that follow ``order``; None if one task can hold the frame.

    The frame is range-partitioned once and written with its partition number,
    so every later read sees the same ranges; a value shared by very many rows is
    cut along the columns after it, in their own order, whatever their types.
    """
    ranges = -(-rows // scale.single_task_rows)
    if ranges <= 1:
        return None
    placed = frame.repartitionByRange(ranges, *order).withColumn(out, F.spark_partition_id())
    return materialise(placed, "ranges").repartition(ranges, out)


def prefix_sums(
    frame: DataFrame,
    value: str,
    sums: Mapping[str, Column],
    *,
    partition_by: Sequence[str] = (),
    tie: str | None = None,
    descending: bool = False,
    rows: int | None = None,
    costly: bool = False,
    scale: Scale = SCALE,
) -> DataFrame:
    """Inclusive running sums in the order of ``value`` (then ``tie`` ascending).

    ``value`` must be a non-null double and ``tie`` unique, of any type that can
    be ordered; without ``tie`` the (partition, value) pairs must be distinct.
    ``rows`` is an upper bound of the rows of the frame, if the caller knows one
    (and has checked the values).  A ``costly`` frame is written out before it
    is counted.  One set of ranges serves all partitions.
    """
    keys = list(partition_by)
    if costly and rows is not None and rows > scale.single_task_rows:
        frame, rows = materialise(frame, "sorted"), None
    names = list(sums)
    work = frame.select("*", *[c.alias(f"__in_{n}") for n, c in sums.items()])
    order = [F.col(value).desc() if descending else F.col(value).asc()]
    if tie:
        order.append(F.col(tie).asc())
    rows = count_sortable(work, value) if rows is None else rows

    ranged = _range_frame(work, order, "__range", rows, scale)
    running = lambda w: [F.sum(f"__in_{n}").over(w).alias(n) for n in names]
    out = frame.columns + names
    if ranged is None:
        small = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        return work.select(*frame.columns, *running(small))

    inside = (
        W.partitionBy(*keys, "__range")
        .orderBy(*order)
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    local = ranged.select(*frame.columns, "__range", *running(inside))
    totals = ranged.groupBy(*keys, "__range").agg(
        *[F.sum(f"__in_{n}").alias(f"__all_{n}") for n in names]
    )
    before = W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "__range", *[F.sum(f"__all_{n}").over(before).alias(f"__off_{n}") for n in names]
    )
    if not keys:
        # One row per range: one for each ``single_task_rows`` rows.
        offsets = F.broadcast(offsets)
    joined = local.join(offsets, [*keys, "__range"])
    return joined.select(
        *frame.columns,
        *[(F.col(n) + F.coalesce(F.col(f"__off_{n}"), F.lit(0))).alias(n) for n in names],
    ).select(*out)


def _targets(probs: Sequence[float], n: int) -> list[tuple[float, int, int, float]]:
    """(prob, lower index, upper index, weight of the upper) per quantile."""
    out = []
    for p in probs:
        h = p * (n - 1)
        lo = math.floor(h)
        out.append((p, lo, min(lo + 1, n - 1), h - lo))
    return out


def exact_quantiles(
    frame: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    *,
    by: str | None = None,
    scale: Scale = SCALE,
    accuracy: int | None = None,
) -> dict[tuple, list[float] | None]:
    """Linear-interpolation quantiles of many columns, exact at any size.

    Returns ``{(group, column): values}`` with one value per probability, or
    None where no usable value exists; ``group`` is None without ``by``.  The
    result is bounded by groups x columns x probabilities.
    """
    keys = [by] if by else []
    work = frame.select(*keys, *[usable(c).alias(c) for c in columns])
    rows = work.count()
    if rows * len(columns) <= 5 * scale.single_task_rows:
        return _ranked(work, columns, probs, by)

    # Finer sketches on larger tables keep the bracketed values few.
    if accuracy is None:
        accuracy = min(100_000, max(10_000, 6 * rows // scale.single_task_rows))
    result: dict[tuple, list[float] | None] = {}
    for start in range(0, len(columns), scale.unpivot_columns):
        chunk = list(columns[start : start + scale.unpivot_columns])
        found = _bracketed(work, chunk, probs, by, accuracy, everywhere=False)
        lost = {c for (_, c), v in found.items() if v and None in v}
        if lost:  # a sketch missed its error bound: rank every value instead
            found.update(_bracketed(work, sorted(lost), probs, by, accuracy, everywhere=True))
        result.update(found)
    return result


def _ranked(work, columns, probs, by):
    """Quantiles of few rows: count each value, rank the counts."""
    keys = [by] if by else []
    group = [*keys, "feature"]
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in columns])
    tally = work.select(*keys, F.inline(cells)).groupBy(*group, "v").agg(
        F.count("v").alias("n")
    )
    upto = W.partitionBy(*group).orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = tally.select(
        *group,
        "v",
        F.sum("n").over(W.partitionBy(*group)).alias("all"),
        F.sum("n").over(upto).alias("upto"),
        "n",
    )
    aggs = []
    for j, p in enumerate(probs):
        h = F.lit(float(p)) * (F.col("all") - 1)
        lo = F.floor(h)
        hi = F.least(lo + 1, F.col("all") - 1)
        holds = lambda k: (F.col("upto") > k) & (F.col("upto") - F.col("n") <= k)
        aggs += [
            F.max(F.when(holds(lo), F.col("v"))).alias(f"a{j}"),
            F.max(F.when(holds(hi), F.col("v"))).alias(f"b{j}"),
            F.max(h - lo).alias(f"w{j}"),
        ]
    result: dict[tuple, list[float] | None] = {}
    for row in ranked.groupBy(*group).agg(F.max("all").alias("all"), *aggs).collect():
        key = (row[by] if by else None, row["feature"])
        result[key] = (
            [row[f"a{j}"] + (row[f"b{j}"] - row[f"a{j}"]) * row[f"w{j}"] for j in range(len(probs))]
            if row["all"]
            else None
        )
    for c in columns:
        if not by:
            result.setdefault((None, c), None)
    return result


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on keys in which null equals null; the keys come from the left."""
    other = {k: f"__{k}" for k in keys}
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(o)) for k, o in other.items()])
    return left.join(right.withColumnsRenamed(other), same, how).drop(*other.values())


def _bracketed(work, columns, probs, by, accuracy, everywhere):
    keys = [by] if by else []
    slack = 3.0 / accuracy
    if everywhere:
        points = [i / 512 for i in range(1, 512)]
    else:
        points = [min(1.0, max(0.0, p + s)) for p in probs for s in (-slack, slack)]
    sketch = work.groupBy(*keys).agg(
        *[F.percentile_approx(c, points, accuracy).alias(f"a_{i}") for i, c in enumerate(columns)],
        *[F.count(c).alias(f"n_{i}") for i, c in enumerate(columns)],
    )
    counts: dict[tuple, int] = {}
    brackets: dict[str, list[tuple[float, float]]] = {c: [] for c in columns}
    edges: dict[str, set[float]] = {c: set() for c in columns}
    for row in sketch.collect():
        for i, c in enumerate(columns):
            counts[(row[by] if by else None, c)] = row[f"n_{i}"]
            marks = row[f"a_{i}"]
            if marks is None:
                continue
            if everywhere:
                edges[c] |= set(marks)
                continue
            for j, p in enumerate(probs):
                lo = -_INF if p <= slack else marks[2 * j]
                hi = _INF if p >= 1 - slack else marks[2 * j + 1]
                brackets[c].append((lo, hi))

    kept: dict[str, list[int] | None] = {}
    splits: dict[str, list[float]] = {}
    for c in columns:
        if everywhere:
            splits[c], kept[c] = sorted(edges[c]), None
            continue
        merged: list[list[float]] = []
        for lo, hi in sorted(brackets[c]):
            if merged and lo <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], hi)
            else:
                merged.append([lo, hi])
        inner = sorted(
            {e for lo, hi in merged for e in (lo, after(hi) if hi < _INF else _INF) if math.isfinite(e)}
        )
        starts = [-_INF, *inner]
        kept[c] = [k for k, s in enumerate(starts) if any(lo <= s <= hi for lo, hi in merged)]
        splits[c] = inner

    ranged = many_value_ranges(work, splits, {c: f"__r{i}" for i, c in enumerate(columns)})
    cells = []
    for i, c in enumerate(columns):
        inside = F.col(c) if kept[c] is None else F.when(F.col(f"__r{i}").isin(kept[c]), F.col(c))
        cells.append(
            F.struct(
                F.lit(c).alias("feature"),
                F.col(f"__r{i}").alias("range"),
                inside.alias("v"),
                F.col(c).isNotNull().alias("present"),
            )
        )
    tally = (
        ranged.select(*keys, F.inline(F.array(*cells)))
        .filter("present")
        .groupBy(*keys, "feature", "range", "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    group = [*keys, "feature"]
    totals = tally.groupBy(*group, "range").agg(F.sum("n").alias("n"))
    before = W.partitionBy(*group).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*group, "range", F.sum("n").over(before).alias("off"))
    inside = (
        W.partitionBy(*group, "range").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    ranked = (
        null_safe_join(tally.withColumn("cum", F.sum("n").over(inside)), offsets, [*group, "range"])
        .withColumn("last", F.col("cum") + F.coalesce("off", F.lit(0)) - 1)
        .withColumn("first", F.col("last") - F.col("n") + 1)
    )
    spark = work.sparkSession
    wanted = [
        (g, c, j, lo, hi)
        for (g, c), n in counts.items()
        if n
        for j, (_, lo, hi, _) in enumerate(_targets(probs, n))
    ]
    schema = "feature string, j int, lo long, hi long"
    if by:
        by_type = work.schema[by].dataType.simpleString()
        small = spark.createDataFrame(wanted, f"`{by}` {by_type}, {schema}")
    else:
        small = spark.createDataFrame([w[1:] for w in wanted], schema)
    # groups x columns x probabilities rows
    hits = (
        null_safe_join(ranked, F.broadcast(small), group)
        .groupBy(*group, "j")
        .agg(
            F.max(F.when(F.col("lo").between(F.col("first"), F.col("last")), F.col("v"))).alias("a"),
            F.max(F.when(F.col("hi").between(F.col("first"), F.col("last")), F.col("v"))).alias("b"),
        )
    )
    found: dict[tuple, list[float | None] | None] = {
        (g, c): [None] * len(probs) if n else None for (g, c), n in counts.items()
    }
    for row in hits.collect():
        key = (row[by] if by else None, row["feature"])
        if row["a"] is not None and row["b"] is not None:
            weight = _targets(probs, counts[key])[row["j"]][3]
            found[key][row["j"]] = row["a"] + (row["b"] - row["a"]) * weight
    return found


def hash_position(id_column: str, seed: int) -> Column:
    """A repeatable pseudo-random place in [0, 16^15) for each id."""
    digest = F.md5(F.concat_ws(":", F.col(id_column).cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def hash_sample(frame: DataFrame, id_column: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows chosen by the hash of a unique id, the same ones
    whatever the partitioning.

    A threshold just above n/rows leaves little more than ``n`` rows to sort.
    """
    total = frame.count()
    place = frame.withColumn("__place", hash_position(id_column, seed))
    share = min(1.0, (n + 10 * math.sqrt(n) + 100) / max(total, 1))
    survivors = place.filter(F.col("__place") <= int(share * 16**15))
    if share < 1.0 and survivors.count() < n:
        survivors = place
    return survivors.orderBy("__place", id_column).limit(n).drop("__place")


def average_rank(frame: DataFrame, value: str, out: str) -> DataFrame:
    """Descending rank with ties at their mean, cut to a whole number.

    For report-sized tables (one row per feature).
    """
    tied = W.partitionBy(value)
    return frame.withColumn(
        out,
        F.floor(
            F.rank().over(W.orderBy(F.col(value).desc()))
            + (F.count(F.lit(1)).over(tied) - 1) / 2
        ).cast("long"),
    )
