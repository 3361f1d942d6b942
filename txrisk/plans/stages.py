"""The batch stages end to end: each reads tables and writes tables.

    ingest -> describe -> build_features -> train -> monitor

Data tables are Parquet, report tables are CSV under ``reports``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.functions.scalar import iso_date, nulls_for_nan
from txrisk.operators import drift as D
from txrisk.operators import encoding as E
from txrisk.operators import boosting, joins, modeling, profile
from txrisk.operators import ranking as R
from txrisk.session import materialise
from txrisk.settings import HEADLINE_REVIEW_RATES, REVIEW_CAPACITY, SCALE, TRAIN, VALID, DriftRules, PeriodRules, Scale
from txrisk.sources import tables, typing

# Columns whose type is given rather than found.
PINNED_TYPES = {
    "TransactionID": "int",
    "TransactionDT": "int",
    "isFraud": "tinyint",
    "TransactionAmt": "double",
}


def _report(frame: DataFrame, out: str, name: str) -> None:
    tables.write_csv(frame, f"{out}/reports/{name}")


def ingest(
    transactions: DataFrame,
    identity: DataFrame,
    out: str,
    key: str = "TransactionID",
    flag: str = "has_identity",
) -> DataFrame:
    """Join the side table under a contract, narrow the types, write the table.
    Returns the contract report."""
    identity, _ = tables.rename_by_pattern(identity, r"id-\d{2}", "-", "_")
    width = len(transactions.columns) + len(identity.columns)
    joined = joins.enrich_one_to_one(
        nulls_for_nan(transactions), nulls_for_nan(identity), key, flag
    )
    joined = materialise(joined, "joined")
    tables.write_parquet(typing.apply_narrowing(joined, typing.narrowing_plan(joined, PINNED_TYPES)), out)
    written = joined.sparkSession.read.parquet(out)
    return joins.join_contract(written, key, transactions.count(), width)


def describe(
    joined: DataFrame,
    out: str,
    blocks_of: Sequence[str],
    spec: E.EncoderSpec,
    categories: Sequence[str] = ("ProductCD",),
    scale: Scale = SCALE,
) -> None:
    """Balance, column profile, null-pattern blocks and rates as reports."""
    _report(profile.class_balance(joined, spec.label), out, "class_balance")
    found = materialise(profile.column_profile(joined, scale=scale), "profile")
    _report(found.orderBy("family", "column"), out, "column_profile")
    _report(profile.missing_profile(found), out, "missing_profile")
    _report(profile.family_summary(found), out, "family_summary")
    _report(profile.null_pattern_blocks(joined, spec.id, blocks_of), out, "null_pattern_blocks")
    for c in categories:
        _report(profile.rate_by_category(joined, c, spec.label), out, f"rate_by_{c}")


def read_blocks(spark: SparkSession, out: str) -> tuple[tuple[str, ...], ...]:
    """Null-pattern blocks as the describe stage wrote them, one row a block."""
    listed = tables.read_csv(spark, f"{out}/reports/null_pattern_blocks").orderBy("group_id")
    return tuple(tuple(r["columns"]) for r in tables.block_members(listed).collect())


def build_features(
    train: DataFrame, test: DataFrame, out: str, spec: E.EncoderSpec, scale: Scale = SCALE
) -> E.RiskEncoderModel:
    """Split by time, fit on the earlier part, encode everything, check it."""
    spark = train.sparkSession
    labelled, boundary = E.time_split(train, spec.time, scale=scale)
    early = labelled.filter("split = 'train'").drop("split")
    model = E.RiskEncoder(spec, scale=scale).fit(early)
    model.save(f"{out}/encoder")
    part = F.when(F.col(spec.time) <= F.lit(boundary), TRAIN).otherwise(VALID)
    encoded = model.transform(train).withColumn("split", part)
    tables.write_parquet(encoded, f"{out}/features", ["split"])
    tables.write_parquet(model.transform(test), f"{out}/features_test")
    features, unseen = spark.read.parquet(f"{out}/features"), spark.read.parquet(f"{out}/features_test")
    _report(E.split_summary(features, spec.time, spec.label), out, "split_summary")
    _report(model.column_decisions(spark), out, "column_decisions")
    if model.block_evidence is not None:
        _report(model.block_evidence, out, "block_reduction")
    _report(E.feature_manifest(model, features, unseen), out, "feature_manifest")
    shares = [f"{c}_freq" for c in model.state["counted"]]
    _report(E.unseen_share(unseen, shares), out, "unseen_share")
    _report(E.feature_checks(features, unseen, model.feature_names, spec.label), out, "feature_checks")
    return model


def train(
    out: str,
    spark: SparkSession,
    spec: E.EncoderSpec,
    features: Sequence[str],
    candidates: Sequence[modeling.Candidate],
    folds: int = 4,
    rates: Sequence[float] = HEADLINE_REVIEW_RATES,
    capacity: float = REVIEW_CAPACITY,
    scale: Scale = SCALE,
) -> tuple[modeling.Candidate, float]:
    """Compare the candidates and the prior on the later part, drop the entity
    family if that costs little, cross-validate the winner at its round, price
    every cut-off, explain, fit again on all rows with rounds scaled by their
    growth, score the test table.  Returns the winner and the threshold chosen
    within capacity."""
    names = R.Scored(spec.id, "score", spec.label, spec.amount)
    table = spark.read.parquet(f"{out}/features")
    early, late = table.filter("split = 'train'"), table.filter("split = 'valid'")
    fitted: dict = {}
    ranking = modeling.compare_candidates(
        candidates, early, late, features, names, scale, prior=True, fitted=fitted, rates=rates, capacity=capacity
    )
    ranking = materialise(ranking, "comparison")
    _report(ranking, out, "model_comparison")
    models = ranking.filter(F.col("model") != modeling.PRIOR)
    first = models.orderBy(F.desc("pr_auc"), "model").first()
    winner, model = next(c for c in candidates if c.name == first["model"]), fitted[first["model"]]

    family = modeling.entity_features(features)
    if family:
        verdict = modeling.ablation(winner, early, late, features, family, names, scale=scale).first()
        _report(spark.createDataFrame([verdict.asDict()]), out, "ablation")
        if verdict["drop_family"]:
            features = [c for c in features if c not in set(family)]
            model = modeling.fit(winner, early, features, spec.label, late)
    grown = isinstance(model, boosting.BoostedModel)
    if grown:
        _report(boosting.log_frame(late, model).orderBy("round"), out, "rounds")
    fixed = winner.with_rounds(model.best_round) if grown else winner

    cv = materialise(modeling.cross_validate(fixed, table, features, spec.time, names, folds, scale), "cv")
    _report(cv.orderBy("fold"), out, "cv_results")
    _report(modeling.fold_stability(cv), out, "cv_summary")

    tables.write_parquet(
        modeling.score(winner, model, late, features, [spec.id, spec.time, spec.label], {spec.amount: "amount"}),
        f"{out}/scores",
    )
    scored = spark.read.parquet(f"{out}/scores")
    names = R.Scored(spec.id, "score", spec.label, "amount")
    totals = R.totals_of(scored, names)
    curve = materialise(R.cost_curve(scored, names, scale=scale, totals=totals), "curve")
    _report(R.curve_thin(curve, rows=totals.rows + 1), out, "cost_curve")
    _report(R.threshold_table(scored, curve, rates, totals.rows), out, "thresholds")
    point = R.best_operating_point(curve, capacity).first()
    span = scored.agg(F.min(spec.time).alias("lo"), F.max(spec.time).alias("hi"))
    days = span.select((F.col("hi") - F.col("lo")) / 86400).first()[0]
    chosen = spark.createDataFrame([point.asDict()]).withColumn(
        "annual_savings", R.annualised(F.col("savings"), F.lit(float(days)))
    )
    _report(chosen, out, "operating_point")

    _report(modeling.importance(model, late, features), out, "importance")
    if not grown:
        parts = modeling.linear_contributions(model, late, features, [spec.id])
        tables.write_parquet(modeling.row_explanations(parts, spec.id, features), f"{out}/explanations")

    threshold = float(point["threshold"])
    test = spark.read.parquet(f"{out}/features_test")
    final, final_model = modeling.refit_all(
        fixed.with_rounds, model.best_round if grown else 0, early.count(), table, features, spec.label
    )
    tables.write_parquet(
        modeling.batch_scores(final, final_model, test, features, spec.id, threshold), f"{out}/test_scores"
    )
    used = [(c, final.name, final_model.best_round if grown else None) for c in features]
    _report(spark.createDataFrame(used, "feature string, model string, rounds int"), out, "final_model")
    return winner, threshold


def monitor(
    out: str,
    spark: SparkSession,
    spec: E.EncoderSpec,
    features: Sequence[str],
    importance: DataFrame | None,
    threshold: float,
    expected_rate: float,
    rules: DriftRules = DriftRules(),
    periods: PeriodRules = PeriodRules(),
    scale: Scale = SCALE,
) -> str:
    """Weekly performance, drift by month, the verdict, and a JSON bundle of all of these.

    Without `importance` the weights that the training stage wrote are used.
    """
    if importance is None:
        importance = tables.read_csv(spark, f"{out}/reports/importance").select(
            "feature", F.col("weight").cast("double").alias("weight")
        )
    scored = spark.read.parquet(f"{out}/scores")
    week = F.date_format(F.date_trunc("week", F.timestamp_seconds(spec.time)), "yyyy-MM-dd")
    names = R.Scored(spec.id, "score", spec.label, "amount")
    weekly = R.period_performance(scored.withColumn("week", week), "week", names, periods, scale)
    weekly = materialise(weekly, "weekly")
    _report(weekly, out, "weekly_performance")

    table = spark.read.parquet(f"{out}/features").filter("split = 'train'")
    month = F.substring(iso_date(spec.time), 1, 7)
    current = spark.read.parquet(f"{out}/features_test").withColumn("period", month)
    drift = materialise(
        D.compare_features(table, current, features, "period", rules, scale), "drift"
    )
    _report(drift, out, "feature_drift")
    _report(D.top_drift(drift), out, "top_drift")
    latest = spark.read.parquet(f"{out}/test_scores").join(current.select(spec.id, "period"), spec.id)
    moved = materialise(
        D.score_drift(latest, "period", drift, importance, threshold, expected_rate, rules=rules, scale=scale),
        "score-drift",
    )
    _report(moved, out, "score_drift")
    verdict = materialise(D.drift_verdict(moved, rules), "verdict")
    _report(verdict, out, "verdict")
    parts = {
        "feature_drift": (drift, ["period", "feature"]),
        "score_drift": (moved, ["period"]),
        "verdict": (verdict, ["verdict"]),
        "weekly_performance": (weekly, ["period"]),
    }
    tables.report_bundle(parts).coalesce(1).write.mode("overwrite").text(f"{out}/reports/bundle")
    return verdict.first()["verdict"]
