"""Has the data moved?  PSI, KS and missingness per feature and period, one
importance-weighted number per period, and a verdict."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from txrisk.functions.scalar import drift_band, usable
from txrisk.operators.joins import broadcast_if_small
from txrisk.operators.ordering import (
    after,
    approximate_cuts,
    exact_quantiles,
    many_value_ranges,
    null_safe_join,
)
from txrisk.session import materialise
from txrisk.settings import DRIFT, SCALE, DriftRules, Scale

_PERIODS_AT_ONCE = 60
# Up to so many partitions Spark deals rows straight to their files; beyond, a task first holds and sorts its rows.
_TASKS = 200


def missing_rate(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of null, NaN and infinite values per column."""
    aggs = [F.avg(F.when(usable(c).isNull(), 1.0).otherwise(0.0)).alias(c) for c in columns]
    return frame.agg(*aggs).unpivot([], list(columns), "feature", "missing_rate")


def quantile_edges(
    frame: DataFrame, columns: Sequence[str], bins: int, scale: Scale = SCALE
) -> dict[str, list[float]]:
    """Distinct bucket edges per column at ``bins`` equal shares."""
    probs = [i / bins for i in range(bins + 1)]
    found = exact_quantiles(frame, columns, probs, scale=scale)
    return {c: sorted(set(v)) if v else [] for (_, c), v in found.items()}


def bucket_counts(
    frame: DataFrame,
    edges: dict[str, list[float]],
    bins: int,
    by: Sequence[str] = (),
    scale: Scale = SCALE,
) -> DataFrame:
    """(by..., feature, rows, missing, b0, b1, ...): usable values per bucket.

    The outer edges are open and empty buckets count zero.  Buckets are found
    on the wide rows; stacked rows are aggregated where they arise.
    """
    features = list(edges)
    parts = []
    for start in range(0, len(features), scale.unpivot_columns):
        chunk = features[start : start + scale.unpivot_columns]
        work = frame.select(*by, *[usable(c).alias(c) for c in chunk])
        inner = {c: edges[c][1:-1] for c in chunk}
        work = many_value_ranges(work, inner, {c: f"__b{i}" for i, c in enumerate(chunk)})
        cells = [
            F.struct(
                F.lit(c).alias("feature"), F.when(F.col(c).isNotNull(), F.col(f"__b{i}")).alias("b")
            )
            for i, c in enumerate(chunk)
        ]
        parts.append(
            work.select(*by, F.inline(F.array(*cells)))
            .groupBy(*by, "feature")
            .agg(
                F.count(F.lit(1)).alias("rows"),
                F.count_if(F.col("b").isNull()).alias("missing"),
                *[F.count_if(F.col("b") == k).alias(f"b{k}") for k in range(bins)],
            )
        )
    return reduce(DataFrame.unionByName, parts)


def _psi(bins: int, epsilon: float) -> Column:
    terms = []
    for k in range(bins):
        r = F.greatest(F.try_divide(F.col(f"r_b{k}"), F.col("rows_reference")), F.lit(epsilon))
        c = F.greatest(F.try_divide(F.col(f"b{k}"), F.col("rows_current")), F.lit(epsilon))
        terms.append((c - r) * F.ln(c / r))
    return reduce(lambda a, b: a + b, terms)


def psi_by_period(
    reference: DataFrame,
    current: DataFrame,
    features: Sequence[str],
    period: str,
    rules: DriftRules = DRIFT,
    scale: Scale = SCALE,
) -> DataFrame:
    """PSI and missing share of every feature in every period, in one plan.

    Edges are the reference deciles, made distinct.  PSI is null when either
    side has too few usable values or the reference has fewer than three edges.
    """
    edges = quantile_edges(reference, features, rules.bins, scale)
    before = bucket_counts(reference, edges, rules.bins, scale=scale).select(
        "feature",
        (F.col("rows") - F.col("missing")).alias("rows_reference"),
        F.try_divide(F.col("missing"), F.col("rows")).alias("missing_reference"),
        *[F.col(f"b{k}").alias(f"r_b{k}") for k in range(rules.bins)],
    )
    now = bucket_counts(current, edges, rules.bins, [period], scale).withColumn(
        "rows_current", F.col("rows") - F.col("missing")
    )
    cuttable = [c for c, e in edges.items() if len(e) >= 3]
    enough = (
        (F.col("rows_reference") >= rules.min_rows)
        & (F.col("rows_current") >= rules.min_rows)
        & F.col("feature").isin(cuttable)
    )
    gone = F.try_divide(F.col("missing"), F.col("rows"))
    # one row per feature
    return now.join(broadcast_if_small(before), "feature").select(
        F.col(period).alias("period"),
        "feature",
        F.when(enough, _psi(rules.bins, rules.epsilon)).alias("psi"),
        "rows_reference",
        "rows_current",
        "missing_reference",
        gone.alias("missing_current"),
        (gone - F.col("missing_reference")).alias("missing_change"),
    )


def ks_by_period(
    reference: DataFrame,
    current: DataFrame,
    features: Sequence[str],
    period: str,
    rules: DriftRules = DRIFT,
    scale: Scale = SCALE,
) -> DataFrame:
    """Largest gap between the cumulative curves, on all rows of both sides.

    Values are first counted in ranges that hold about equal shares of all
    rows.  At the end of a range the gap is known, and inside it cannot exceed
    what the range's own counts allow; only ranges that could hold a greater gap
    than the greatest known one are then counted value by value.  A range of a
    single value needs no second look.
    """
    sizes = {r[0]: r[1] for r in current.groupBy(period).count().collect()}
    periods = sorted(sizes, key=lambda p: (p is None, p))
    rows = reference.count() + sum(sizes.values())
    parts = []
    for first in range(0, len(periods), _PERIODS_AT_ONCE):
        some = periods[first : first + _PERIODS_AT_ONCE]
        for start in range(0, len(features), scale.unpivot_columns):
            chunk = list(features[start : start + scale.unpivot_columns])
            parts.append(_ks(reference, current, chunk, period, some, rows, rules, scale))
    return reduce(DataFrame.unionByName, parts)


def range_splits(frame: DataFrame, columns: Sequence[str], parts: int) -> dict[str, list[float]]:
    """Starts of ranges with about equal shares of the values; a value that fills a
    whole share is a range of its own."""
    marks = frame.agg(*[approximate_cuts(usable(c), parts).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    splits = {}
    for i, c in enumerate(columns):
        found = marks[f"c{i}"] or []
        frequent = {a for a, b in pairwise(found) if a == b}
        splits[c] = sorted(set(found) | {after(v) for v in frequent})
    return splits


def _ks(reference, current, features, period, periods, rows, rules, scale):
    side = F.coalesce(*[F.when(F.col(period).eqNullSafe(F.lit(p)), i) for i, p in enumerate(periods)])
    values = [usable(c).alias(f"__v{i}") for i, c in enumerate(features)]
    both = reference.select(F.lit(-1).alias("side"), *values).unionByName(
        current.select(side.alias("side"), *values).filter("side is not null")
    )
    cells = [f"__v{i}" for i in range(len(features))]
    parts = min(10_000, max(scale.ks_ranges, rows // scale.single_task_rows))
    # Any splits give the same result; a sample finds fair ones.
    splits = range_splits(both.sample(min(1.0, 200 * parts / max(rows, 1)), seed=1), cells, parts)

    def stacked(some: Sequence[int]) -> DataFrame:
        """side, feature, range, v of some features, where there is a value."""
        ranged = many_value_ranges(both, {cells[i]: splits[cells[i]] for i in some}, {cells[i]: f"__r{i}" for i in some})
        columns = [
            F.struct(F.lit(i).alias("feature"), F.col(f"__r{i}").alias("range"), F.col(f"__v{i}").alias("v")) for i in some
        ]
        return ranged.select("side", F.inline(F.array(*columns))).filter("v is not null")

    sides = [-1, *range(len(periods))]
    names = ["ref", *[f"p{i}" for i in range(len(periods))]]
    counts = [F.count_if(F.col("side") == s).alias(f"n_{m}") for s, m in zip(sides, names, strict=True)]
    # ranges x features rows
    ends = (F.min("v").alias("lo"), F.max("v").alias("hi"))
    first = stacked(range(len(features))).groupBy("feature", "range").agg(*counts, *ends)
    known = materialise(_bounds(first, names, rules), "ranges")
    best = known.groupBy("feature").agg(
        *[F.max(f"t_{m}").alias(f"t_{m}") for m in names], *[F.max(f"gap_{m}").alias(f"gap_{m}") for m in names[1:]]
    )

    wanted = known.filter("open")
    open_rows = {r["feature"]: r["n"] for r in wanted.groupBy("feature").agg(F.sum("rows").alias("n")).collect()}
    unsure = sorted(open_rows)
    # A range holds a small share of all rows: its values are put in order by one task.  Tasks follow
    # the rows, as their bytes tell little: values that recur shrink on the way, not in the sort.
    tasks = min(_TASKS, max(1, -(-sum(open_rows.values()) // scale.single_task_rows)))
    upto = W.partitionBy("feature", "range").orderBy("v").rangeBetween(W.unboundedPreceding, W.currentRow)
    curves = (
        stacked(unsure or [0])
        .join(broadcast_if_small(wanted.select("feature", "range")), ["feature", "range"], "left_semi")
        .repartition(tasks, "feature", "range")
        .select("feature", "range", *[F.count_if(F.col("side") == s).over(upto).alias(m) for s, m in zip(sides, names, strict=True)])
    )
    share = lambda m: F.try_divide(F.col(m) + F.col(f"before_{m}"), F.col(f"t_{m}"))
    finer = (
        curves.join(broadcast_if_small(wanted), ["feature", "range"])
        .groupBy("feature")
        .agg(*[F.max(F.abs(share(m) - share("ref"))).alias(f"fine_{m}") for m in names[1:]])
    )
    enough = lambda m: (F.col(f"t_{m}") >= rules.min_rows) & (F.col("t_ref") >= rules.min_rows)
    kind = current.schema[period].dataType
    per_period = [
        F.struct(
            F.lit(p).cast(kind).alias("period"),
            F.when(enough(m), F.greatest(f"gap_{m}", f"fine_{m}")).alias("ks"),
        )
        for p, m in zip(periods, names[1:], strict=True)
    ]
    label = F.element_at(F.array(*[F.lit(c) for c in features]), F.col("feature") + 1)
    # one row per feature
    return best.join(finer, "feature", "left").select(label.alias("feature"), F.inline(F.array(*per_period)))


def _bounds(counted: DataFrame, names: Sequence[str], rules: DriftRules) -> DataFrame:
    """Adds totals, counts before each range, the gap at its end, and whether a greater
    gap than the greatest known one may lie inside it."""
    whole = W.partitionBy("feature")
    earlier = whole.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    work = counted.select(
        "*",
        *[F.coalesce(F.sum(f"n_{m}").over(earlier), F.lit(0)).alias(f"before_{m}") for m in names],
        *[F.sum(f"n_{m}").over(whole).alias(f"t_{m}") for m in names],
    )
    at = lambda m, end: F.try_divide(F.col(f"before_{m}") + (F.col(f"n_{m}") if end else 0), F.col(f"t_{m}"))
    work = work.select(
        "*",
        *[F.abs(at(m, True) - at("ref", True)).alias(f"gap_{m}") for m in names[1:]],
        *[
            F.greatest(F.abs(at(m, True) - at("ref", False)), F.abs(at(m, False) - at("ref", True))).alias(f"most_{m}")
            for m in names[1:]
        ],
    )
    asked = lambda m: (F.col(f"t_{m}") >= rules.min_rows) & (F.col("t_ref") >= rules.min_rows)
    beats = [asked(m) & (F.col(f"most_{m}") > F.max(f"gap_{m}").over(whole)) for m in names[1:]]
    several = F.col("lo") < F.col("hi")
    return work.select(
        "*",
        F.coalesce(several & reduce(lambda a, b: a | b, beats), F.lit(False)).alias("open"),
        reduce(lambda a, b: a + b, [F.col(f"n_{m}") for m in names]).alias("rows"),
    ).drop(
        "lo", "hi", *[f"n_{m}" for m in names], *[f"most_{m}" for m in names[1:]]
    )


def compare_features(
    reference: DataFrame,
    current: DataFrame,
    features: Sequence[str],
    period: str,
    rules: DriftRules = DRIFT,
    scale: Scale = SCALE,
) -> DataFrame:
    """All measures for every feature and period: one report row each."""
    psi = psi_by_period(reference, current, features, period, rules, scale)
    ks = ks_by_period(reference, current, features, period, rules, scale)
    return null_safe_join(psi, ks, ["period", "feature"], "left").select(
        "period",
        "feature",
        "psi",
        "ks",
        drift_band("psi", rules).alias("band"),
        "rows_reference",
        "rows_current",
        (F.col("rows_current") < rules.low_confidence_rows).alias("low_confidence"),
        "missing_reference",
        "missing_current",
        "missing_change",
    )


def weighted_drift(drift: DataFrame, importance: DataFrame, weight: str = "weight") -> DataFrame:
    """PSI weighted by importance, per period.

    The divisor is the weight of all features, also of those without a PSI.
    Null when the weights do not add up or no feature has a PSI.
    """
    # one row per feature
    weights = broadcast_if_small(importance.select("feature", F.col(weight).alias("w")))
    total = weights.agg(F.sum("w")).first()[0] or 0.0
    score = F.sum(F.col("psi") * F.coalesce("w", F.lit(0.0)))
    return (
        drift.join(weights, "feature", "left")
        .groupBy("period")
        .agg(F.when(F.lit(total > 0), F.try_divide(score, F.lit(total))).alias("weighted_psi"))
    )


def score_drift(
    scored: DataFrame,
    period: str,
    drift: DataFrame,
    importance: DataFrame,
    threshold: float,
    expected_rate: float,
    score: str = "score",
    rules: DriftRules = DRIFT,
    scale: Scale = SCALE,
) -> DataFrame:
    """How scores, alerts and the weighted drift moved from period to period.
    Periods below ``min_rows`` rows are left out."""
    spark = scored.sparkSession
    drift = broadcast_if_small(drift)  # periods x features rows, read twice below
    found = exact_quantiles(scored, [score], [0.5, 0.9, 0.99], by=period, scale=scale)
    kind = scored.schema[period].dataType.simpleString()
    marks = spark.createDataFrame(
        [(p, *q) for (p, _), q in found.items() if q],
        f"period {kind}, score_p50 double, score_p90 double, score_p99 double",
    )
    alert = F.avg(F.when(F.col(score) >= threshold, 1.0).otherwise(0.0))
    moved = scored.groupBy(F.col(period).alias("period")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(score).alias("score_mean"), alert.alias("alert_rate")
    )
    top = importance.orderBy(F.desc("weight"), "feature").limit(rules.top_features)
    top_names = [r["feature"] for r in top.collect()]
    over = F.col("psi") > rules.significant
    counts = drift.groupBy("period").agg(
        F.count_if(over).alias("features_significant"),
        F.count_if(over & F.col("feature").isin(top_names)).alias("top_features_significant"),
    )
    long_enough = moved.filter(F.col("rows") >= rules.min_rows)
    return (
        # one row per period
        reduce(lambda a, b: null_safe_join(a, b, ["period"]), [long_enough, marks, weighted_drift(drift, importance), counts])
        .select(
            "period",
            "rows",
            "score_mean",
            "score_p50",
            "score_p90",
            "score_p99",
            "alert_rate",
            F.try_divide(F.col("alert_rate"), F.lit(expected_rate)).alias("alert_rate_ratio"),
            "weighted_psi",
            "features_significant",
            "top_features_significant",
        )
    )


def drift_verdict(score_table: DataFrame, rules: DriftRules = DRIFT) -> DataFrame:
    """RETRAIN, WATCH or OK from the worst period and the latest one."""
    latest = F.max_by(F.struct("alert_rate_ratio", "top_features_significant"), "period")
    row = score_table.agg(
        F.max("weighted_psi").alias("worst_weighted_psi"), latest.alias("latest")
    ).select("worst_weighted_psi", "latest.*")
    retrain = (F.col("worst_weighted_psi") > rules.retrain_weighted) | (
        F.col("top_features_significant") >= rules.retrain_top_significant
    )
    watch = (F.col("worst_weighted_psi") > rules.watch_weighted) | (
        F.abs(F.col("alert_rate_ratio") - 1) > rules.alert_tolerance
    )
    return row.select(
        "*", F.when(retrain, "RETRAIN").when(watch, "WATCH").otherwise("OK").alias("verdict")
    )


def top_drift(drift: DataFrame, n: int = 25) -> DataFrame:
    """The features that moved most, without the low-confidence ones."""
    return (
        drift.filter(~F.col("low_confidence"))
        .orderBy(F.desc_nulls_last("psi"), "feature", "period")
        .limit(n)
        .select("period", "feature", "psi", "missing_reference", "missing_current")
    )


def psi_grid(drift: DataFrame, importance: DataFrame, periods: Sequence[str]) -> DataFrame:
    """Features down, periods across, the most important feature first."""
    grid = drift.groupBy("feature").pivot("period", list(periods)).agg(F.avg("psi"))
    weights = broadcast_if_small(importance.select("feature", "weight"))
    return (
        grid.join(weights, "feature", "left")
        .orderBy(F.desc_nulls_last("weight"), "feature")
        .drop("weight")
    )
