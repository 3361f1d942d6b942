"""Exact ranking metrics and the money-weighted cost curve.

A scored table has an id, a double score, a 0/1 label and an amount.  Money is
summed as decimals, so totals do not depend on how rows are partitioned.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from txrisk.operators.ordering import count_sortable, prefix_sums
from txrisk.operators.profile import density_histogram
from txrisk.settings import (
    COST,
    HEADLINE_REVIEW_RATES,
    PERIOD,
    REVIEW_CAPACITY,
    SCALE,
    CostModel,
    PeriodRules,
    Scale,
)

MONEY = "decimal(18,4)"


@dataclass(frozen=True)
class Scored:
    """Column names of a scored table."""

    id: str = "id"
    score: str = "score"
    label: str = "label"
    amount: str = "amount"


NAMES = Scored()


def _money(amount: Column) -> Column:
    return F.coalesce(amount.cast(MONEY), F.lit(0).cast(MONEY))


def score_groups(
    frame: DataFrame,
    names: Scored = NAMES,
    by: Sequence[str] = (),
    scale: Scale = SCALE,
    rows: int | None = None,
) -> DataFrame:
    """One row per distinct score, highest first, with running counts: tied
    scores are one threshold, and a score shared by many rows is one row."""
    score = F.col(names.score).cast("double").alias("score")
    rows = count_sortable(frame.select(score), "score") if rows is None else rows
    grouped = frame.groupBy(*by, score).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(names.label).cast("long")).alias("pos")
    )
    return prefix_sums(
        grouped,
        "score",
        {"seen": F.col("n"), "caught": F.col("pos")},
        partition_by=by,
        descending=True,
        rows=rows,
        costly=True,
        scale=scale,
    )


def ranking_metrics(
    frame: DataFrame,
    names: Scored = NAMES,
    by: Sequence[str] = (),
    scale: Scale = SCALE,
    rows: int | None = None,
) -> DataFrame:
    """Average precision, its baseline and lift, and ROC-AUC, per group.

    Both areas are sums over score groups, so one aggregate ends the plan.
    """
    g = score_groups(frame, names, by, scale, rows)
    neg = F.col("n") - F.col("pos")
    neg_seen = F.col("seen") - F.col("caught")
    sums = g.groupBy(*by).agg(
        F.sum("n").alias("rows"),
        F.sum("pos").alias("positives"),
        F.sum(F.col("pos") * (F.col("caught") / F.col("seen"))).alias("__precision"),
        F.sum(F.col("pos").cast("double") * (neg_seen - neg / 2)).alias("__above"),
    )
    pairs = F.col("positives").cast("double") * (F.col("rows") - F.col("positives"))
    ap = F.try_divide(F.col("__precision"), F.col("positives"))
    base = F.try_divide(F.col("positives"), F.col("rows"))
    return sums.select(
        *by,
        "rows",
        "positives",
        ap.alias("pr_auc"),
        base.alias("pr_auc_baseline"),
        F.try_divide(ap, base).alias("pr_auc_lift"),
        (1 - F.try_divide(F.col("__above"), pairs)).alias("roc_auc"),
    )


def pr_curve(
    frame: DataFrame, names: Scored = NAMES, by: Sequence[str] = (), scale: Scale = SCALE
) -> DataFrame:
    """Precision and recall at every distinct score, closed by (1, 0)."""
    g = score_groups(frame, names, by, scale)
    totals = frame.groupBy(*by).agg(F.sum(F.col(names.label).cast("long")).alias("positives"))
    if by:
        with_total = g.join(totals, list(by))
    else:
        with_total = g.withColumn("positives", totals.scalar())
    points = with_total.select(
        *by,
        F.col("score").alias("threshold"),
        (F.col("caught") / F.col("seen")).alias("precision"),
        F.try_divide(F.col("caught"), F.col("positives")).alias("recall"),
    )
    ends = totals.select(
        *by,
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    return points.unionByName(ends)


@dataclass(frozen=True)
class Totals:
    """Size of a scored table: its rows, positives and their money."""

    rows: int
    positives: int
    value: float


def totals_of(frame: DataFrame, names: Scored = NAMES) -> Totals:
    """One row, from one pass; also refuses rows without a score."""
    y = F.col(names.label).cast("long")
    s = F.col(names.score).cast("double")
    hit = F.when(y == 1, _money(F.col(names.amount))).otherwise(F.lit(0).cast(MONEY))
    row = frame.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(y).alias("positives"),
        F.sum(hit).alias("value"),
        F.count_if(s.isNull() | F.isnan(s)).alias("bad"),
    ).first()
    if row["bad"]:
        raise ValueError(f"{row['bad']} rows have no score")
    return Totals(row["rows"], row["positives"] or 0, float(row["value"] or 0))


def ranked_rows(
    frame: DataFrame, names: Scored = NAMES, rows: int | None = None, scale: Scale = SCALE
) -> DataFrame:
    """Each row's place, riskiest first (the lower id on ties), with positives
    and their value caught up to it."""
    work = frame.select(
        F.col(names.id).alias("id"),
        F.col(names.score).cast("double").alias("threshold"),
        F.col(names.label).cast("long").alias("y"),
        _money(F.col(names.amount)).alias("a"),
    )
    hit = F.when(F.col("y") == 1, F.col("a")).otherwise(F.lit(0).cast(MONEY))
    return prefix_sums(
        work,
        "threshold",
        {"n_flagged": F.lit(1), "caught": F.col("y"), "caught_value": hit},
        tie="id",
        descending=True,
        rows=rows,
        scale=scale,
    ).select(
        "n_flagged",
        "threshold",
        "caught",
        F.col("caught_value").cast("decimal(38,4)").alias("caught_value"),
    )


def cost_curve(
    frame: DataFrame,
    names: Scored = NAMES,
    cost: CostModel = COST,
    scale: Scale = SCALE,
    totals: Totals | None = None,
) -> DataFrame:
    """What flagging the top k rows costs, for every k from 0 to n."""
    none = frame.sparkSession.range(1).select(
        F.lit(0).cast("long").alias("n_flagged"),
        F.lit(float("inf")).alias("threshold"),
        F.lit(0).cast("long").alias("caught"),
        F.lit(0).cast("decimal(38,4)").alias("caught_value"),
    )
    t = totals or totals_of(frame, names)
    points = ranked_rows(frame, names, t.rows, scale).unionByName(none)
    base = points.select(
        "n_flagged",
        (F.col("n_flagged") / F.lit(t.rows)).alias("review_rate"),
        "threshold",
        F.col("caught").cast("double").alias("positives_caught"),
        (F.lit(t.positives) - F.col("caught")).cast("double").alias("positives_missed"),
        (F.col("n_flagged") - F.col("caught")).cast("double").alias("false_alarms"),
        F.coalesce(F.try_divide(F.col("caught"), F.lit(t.positives)), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(F.col("caught"), F.col("n_flagged")), F.lit(0.0)).alias("precision"),
        F.col("caught_value").cast("double").alias("__value"),
        (F.lit(t.value) - F.col("caught_value").cast("double")).alias("__missed_value"),
        F.lit(t.value + t.positives * cost.chargeback).alias("__nothing"),
    )
    missed = F.col("__missed_value") + F.col("positives_missed") * cost.chargeback
    caught = F.col("positives_caught") * cost.review + (1 - cost.recovery) * (
        F.col("__value") + F.col("positives_caught") * cost.chargeback
    )
    alarms = F.col("false_alarms") * (cost.review + cost.friction)
    priced = base.select(
        "*",
        missed.alias("cost_missed"),
        caught.alias("cost_caught"),
        alarms.alias("cost_false_alarm"),
        (missed + caught + alarms).alias("total_cost"),
    )
    return priced.select(
        *[c for c in priced.columns if not c.startswith("__")],
        (F.col("__nothing") - F.col("total_cost")).alias("savings"),
    )


_POINT = ["threshold", "review_rate", "n_flagged", "recall", "precision", "total_cost", "savings"]


def best_operating_point(curve: DataFrame, capacity: float | None = None) -> DataFrame:
    """The cheapest row of the curve, the smallest cut on ties, optionally
    within a review capacity (flagging nothing is always within it)."""
    allowed = curve if capacity is None else curve.filter(F.col("review_rate") <= capacity)
    best = F.min_by(F.struct(*_POINT), F.struct("total_cost", "n_flagged"))
    return allowed.agg(best.alias("p")).select("p.*")


def annualised(savings: Column, days: Column) -> Column:
    return savings * 365 / F.greatest(days, F.lit(1))


def _cuts(frame: DataFrame, rates: Sequence[float], rows: int) -> DataFrame:
    """One row per review rate with the number of rows it stands for."""
    wanted = frame.sparkSession.createDataFrame([(float(r),) for r in rates], "review_rate double")
    k = F.greatest(F.lit(1), F.bround(F.lit(rows) * F.col("review_rate"), 0).cast("long"))
    return wanted.withColumn("n_reviewed", k)


def review_rate_metrics(
    frame: DataFrame,
    rates: Sequence[float] = HEADLINE_REVIEW_RATES,
    names: Scored = NAMES,
    scale: Scale = SCALE,
) -> DataFrame:
    """What reviewing the riskiest share catches, for each share."""
    t = totals_of(frame, names)
    ranked = ranked_rows(frame, names, t.rows, scale).withColumnRenamed("n_flagged", "n_reviewed")
    # one row per review rate
    at = ranked.join(F.broadcast(_cuts(frame, rates, t.rows)), "n_reviewed")
    return at.select(
        "review_rate",
        "n_reviewed",
        "threshold",
        F.col("caught").alias("positives_caught"),
        F.coalesce(F.try_divide(F.col("caught"), F.lit(t.positives)), F.lit(0.0)).alias("recall"),
        (F.col("caught") / F.col("n_reviewed")).alias("precision"),
    )


def threshold_table(
    frame: DataFrame,
    curve: DataFrame,
    rates: Sequence[float] = HEADLINE_REVIEW_RATES,
    rows: int | None = None,
) -> DataFrame:
    """The rows of the cost curve at the headline review rates."""
    picked = curve.withColumnRenamed("n_flagged", "n_reviewed").drop("review_rate")
    # one row per review rate
    cuts = _cuts(frame, rates, frame.count() if rows is None else rows)
    return picked.join(F.broadcast(cuts), "n_reviewed").select(
        "review_rate",
        "n_reviewed",
        "threshold",
        F.col("positives_caught").cast("long").alias("positives_caught"),
        "recall",
        "precision",
        "total_cost",
        "savings",
    )


def nearest_savings(table: DataFrame, rate: float) -> DataFrame:
    """Savings at the review rate closest to the one asked for."""
    off = F.abs(F.col("review_rate") - rate)
    return table.agg(
        F.min_by(F.struct("review_rate", "savings"), F.struct(off, F.col("review_rate"))).alias("p")
    ).select("p.*")


def curve_thin(curve: DataFrame, max_rows: int = 2000, rows: int | None = None) -> DataFrame:
    """Every m-th row of the curve from the first, about ``max_rows`` of them.

    ``rows`` is the length of the curve, if known: one more than the table's.
    """
    rows = curve.count() if rows is None else rows
    step = 1 if rows <= max_rows else rows // max_rows
    return curve.filter(F.col("n_flagged") % step == 0)


def recall_by_value(
    frame: DataFrame, rate: float = REVIEW_CAPACITY, names: Scored = NAMES, scale: Scale = SCALE
) -> DataFrame:
    """Recall by count against recall by money at one review rate, and the
    mean amount of what is caught and missed."""
    t = totals_of(frame, names)
    ranked = ranked_rows(frame, names, t.rows, scale).withColumnRenamed("n_flagged", "n_reviewed")
    value = F.col("caught_value").cast("double")
    return ranked.join(F.broadcast(_cuts(frame, [rate], t.rows)), "n_reviewed").select(
        "review_rate",
        "n_reviewed",
        F.try_divide(F.col("caught"), F.lit(t.positives)).alias("recall_by_count"),
        F.try_divide(value, F.lit(t.value)).alias("recall_by_value"),
        F.try_divide(value, F.col("caught")).alias("mean_caught"),
        F.try_divide(F.lit(t.value) - value, F.lit(t.positives) - F.col("caught")).alias("mean_missed"),
    )


def rate_name(rate: float) -> str:
    """``0.005`` gives ``0p500pct``, the suffix of the report columns."""
    whole, thousandths = divmod(round(rate * 100_000), 1000)
    return f"{whole}p{thousandths:03d}pct"


def evaluate_all(
    frame: DataFrame,
    rates: Sequence[float] = HEADLINE_REVIEW_RATES,
    capacity: float = REVIEW_CAPACITY,
    names: Scored = NAMES,
    cost: CostModel = COST,
    scale: Scale = SCALE,
) -> DataFrame:
    """All metrics of one scored table in one row.

    The curve's best points and review-rate rows come from one pass over it.
    """
    t = totals_of(frame, names)
    curve = cost_curve(frame, names, cost, scale, t)
    cuts = _cuts(frame, rates, t.rows)
    marked = curve.join(
        F.broadcast(cuts.withColumnRenamed("n_reviewed", "n_flagged").withColumnRenamed("review_rate", "at")),
        "n_flagged",
        "left",
    )
    cheapest = F.struct("total_cost", "n_flagged")
    point = F.struct(*_POINT)
    per_rate = []
    for r in rates:
        here = F.col("at") == F.lit(float(r))
        per_rate += [
            F.max(F.when(here, F.col("recall"))).alias(f"recall_at_{rate_name(r)}"),
            F.max(F.when(here, F.col("precision"))).alias(f"precision_at_{rate_name(r)}"),
        ]
    within = F.col("review_rate") <= capacity
    costs = marked.agg(
        *per_rate,
        F.min_by(point, cheapest).alias("u"),
        F.min_by(F.when(within, point), F.when(within, cheapest)).alias("c"),
    ).select(
        *[f"recall_at_{rate_name(r)}" for r in rates],
        *[f"precision_at_{rate_name(r)}" for r in rates],
        F.col("u.savings").alias("best_savings_unconstrained"),
        F.col("u.review_rate").alias("best_review_rate_unconstrained"),
        F.col("c.savings").alias("best_savings_within_capacity"),
        F.col("c.threshold").alias("best_threshold_within_capacity"),
        F.col("c.recall").alias("best_recall_within_capacity"),
    )
    names_of_areas = ["pr_auc", "pr_auc_baseline", "pr_auc_lift", "roc_auc"]
    areas = ranking_metrics(frame, names, scale=scale, rows=t.rows).select(*names_of_areas).first()
    return costs.select(*[F.lit(areas[c]).cast("double").alias(c) for c in names_of_areas], "*")


def period_performance(
    frame: DataFrame,
    period: str,
    names: Scored = NAMES,
    rules: PeriodRules = PERIOD,
    scale: Scale = SCALE,
) -> DataFrame:
    """Ranking metrics per period; short periods are left out, incomplete ones
    marked, and the mean lift of the complete ones set beside each."""
    metrics = ranking_metrics(frame, names, [period], scale).filter(
        (F.col("rows") >= rules.min_rows) & (F.col("positives") >= rules.min_positives)
    )
    full = F.col("rows") >= rules.full_rows
    return metrics.select(
        F.col(period).alias("period"),
        "rows",
        "positives",
        F.col("pr_auc_baseline").alias("positive_rate"),
        "pr_auc",
        "pr_auc_lift",
        "roc_auc",
        full.alias("is_full_period"),
        # a handful of periods
        F.avg(F.when(full, F.col("pr_auc_lift"))).over(W.partitionBy()).alias("mean_full_lift"),
    )


def score_histogram(
    frame: DataFrame, score: str, label: str, edges: int = 60, lo: float = 0.0, hi: float = 1.0
) -> DataFrame:
    """Scores per class between ``edges`` fixed edges on [lo, hi]."""
    return density_histogram(frame, F.col(score).cast("double"), label, edges - 1, (lo, hi))
