"""Ranking metrics, cost curve and drift over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from txrisk.functions import scalar as X
from txrisk.operators import drift as D
from txrisk.operators import modeling as M
from txrisk.operators import ranking as R
from txrisk.plans.inputs import (
    CURVE,
    DRIFT_FEATURES,
    FACTS,
    LINES,
    RANKED,
    SCORED,
    facts,
    lines_by_year,
    scored,
)
from txrisk.plans.registry import query, rounded
from txrisk.settings import DriftRules, PeriodRules, Scale

RATES = [0.005, 0.01, 0.02, 0.05]
_CUTS = """cuts(review_rate) AS (VALUES (CAST(0.005 AS DOUBLE)), (CAST(0.01 AS DOUBLE)),
    (CAST(0.02 AS DOUBLE)), (CAST(0.05 AS DOUBLE))),
  at_k AS (SELECT review_rate, greatest(1, CAST(round_even((SELECT count(*) FROM scored) * review_rate, 0) AS BIGINT)) AS k FROM cuts)"""


def _area_sql(source: str, by: str = "") -> str:
    """Average precision and ROC-AUC from score groups, per group ``by``."""
    part = f"PARTITION BY {by} " if by else ""
    cols = f"{by}, " if by else ""
    return f"""g AS (SELECT {cols}score, count(*) AS n, CAST(sum(label) AS BIGINT) AS pos FROM {source} GROUP BY {cols}score),
      c AS (SELECT *, CAST(sum(n) OVER ({part}ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seen,
        CAST(sum(pos) OVER ({part}ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS caught FROM g),
      area AS (SELECT {cols}CAST(sum(n) AS BIGINT) AS rows, CAST(sum(pos) AS BIGINT) AS positives,
        sum(pos * (caught / CAST(seen AS DOUBLE))) / sum(pos) AS pr_auc,
        sum(pos) / CAST(sum(n) AS DOUBLE) AS pr_auc_baseline,
        1 - sum(pos * ((seen - caught) - (n - pos) / CAST(2 AS DOUBLE))) / (CAST(sum(pos) AS DOUBLE) * (sum(n) - sum(pos))) AS roc_auc
        FROM c GROUP BY {by or 'ALL'})"""


_AREA = f"{SCORED}, {_area_sql('scored')}"


@query(
    "average_precision",
    f"""WITH {_AREA} SELECT rows, positives, round(pr_auc, 6) AS pr_auc, round(pr_auc_baseline, 6) AS pr_auc_baseline,
          round(pr_auc / pr_auc_baseline, 6) AS pr_auc_lift FROM area""",
)
def average_precision(spark, sf):
    return rounded(R.ranking_metrics(scored(spark, sf)).drop("roc_auc"))


@query("roc_auc", f"WITH {_AREA} SELECT round(roc_auc, 6) AS roc_auc FROM area")
def roc_auc(spark, sf):
    return rounded(R.ranking_metrics(scored(spark, sf)).select("roc_auc"))


@query(
    "review_rate_metrics",
    f"""WITH {SCORED}, {RANKED}, {_CUTS} SELECT review_rate, a.k AS n_reviewed, score AS threshold,
          caught AS positives_caught, round(caught / CAST(p AS DOUBLE), 6) AS recall,
          round(caught / CAST(a.k AS DOUBLE), 6) AS precision
        FROM at_k a JOIN ranked r ON a.k = r.k, totals""",
)
def review_rate_metrics(spark, sf):
    return rounded(R.review_rate_metrics(scored(spark, sf), RATES))


_CURVE_COLUMNS = """n_flagged, round(review_rate, 6) AS review_rate, threshold, positives_caught, positives_missed,
    false_alarms, round(recall, 6) AS recall, round(precision, 6) AS precision,
    round(cost_missed, 4) AS cost_missed, round(cost_caught, 4) AS cost_caught, cost_false_alarm,
    round(total_cost, 4) AS total_cost, round(savings, 4) AS savings"""
_POINT_COLUMNS = """n_flagged, round(review_rate, 6) AS review_rate, threshold, round(recall, 6) AS recall,
    round(precision, 6) AS precision, round(total_cost, 4) AS total_cost, round(savings, 4) AS savings"""
_MONEY = ["cost_missed", "cost_caught", "total_cost", "savings", "annual_savings"]


def _rounded_money(frame):
    return rounded(frame, at=dict.fromkeys(_MONEY, 4))


@query("cost_curve", f"WITH {CURVE} SELECT {_CURVE_COLUMNS} FROM curve")
def cost_curve(spark, sf):
    return _rounded_money(R.cost_curve(scored(spark, sf)))


_TEXT_IDS = CURVE.replace("SELECT event_id AS id", "SELECT CAST(event_id AS VARCHAR) AS id")


@query("cost_curve_text_ids", f"WITH {_TEXT_IDS} SELECT {_CURVE_COLUMNS} FROM curve")
def cost_curve_text_ids(spark, sf):
    """Ids that are text, and so many ranges that each holds a few rows."""
    frame = scored(spark, sf).withColumn("id", F.col("id").cast("string"))
    return _rounded_money(R.cost_curve(frame, scale=Scale(single_task_rows=2000)))


@query("curve_thin", f"WITH {CURVE} SELECT {_CURVE_COLUMNS} FROM curve WHERE n_flagged % (SELECT CASE WHEN count(*) <= 2000 THEN 1 ELSE count(*) // 2000 END FROM curve) = 0")
def curve_thin(spark, sf):
    frame = scored(spark, sf)
    totals = R.totals_of(frame)
    return _rounded_money(R.curve_thin(R.cost_curve(frame, totals=totals), rows=totals.rows + 1))


@query("best_point_unconstrained", f"WITH {CURVE} SELECT {_POINT_COLUMNS} FROM curve ORDER BY total_cost, n_flagged LIMIT 1")
def best_point_unconstrained(spark, sf):
    return _rounded_money(R.best_operating_point(R.cost_curve(scored(spark, sf))))


@query(
    "best_point_capacity",
    f"""WITH {CURVE}, best AS (SELECT * FROM curve WHERE review_rate <= 0.02 ORDER BY total_cost, n_flagged LIMIT 1),
        span AS (SELECT (CAST(floor(epoch(max(ts))) AS BIGINT) - CAST(floor(epoch(min(ts))) AS BIGINT)) / CAST(86400 AS DOUBLE) AS days FROM scored)
        SELECT {_POINT_COLUMNS}, round(savings * 365 / greatest(days, 1), 4) AS annual_savings FROM best, span""",
)
def best_point_capacity(spark, sf):
    frame = scored(spark, sf)
    days = frame.agg(
        (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))) / 86400
    ).scalar()
    best = R.best_operating_point(R.cost_curve(frame), 0.02)
    return _rounded_money(best.withColumn("annual_savings", R.annualised(F.col("savings"), days)))


@query(
    "threshold_table",
    f"""WITH {CURVE}, {_CUTS} SELECT a.review_rate, k AS n_reviewed, threshold, CAST(positives_caught AS BIGINT) AS positives_caught,
          round(recall, 6) AS recall, round(precision, 6) AS precision, round(total_cost, 4) AS total_cost,
          round(savings, 4) AS savings, a.review_rate = 0.02 AS is_nearest
        FROM at_k a JOIN curve c ON a.k = c.n_flagged""",
)
def threshold_table(spark, sf):
    frame = scored(spark, sf)
    totals = R.totals_of(frame)
    table = R.threshold_table(frame, R.cost_curve(frame, totals=totals), RATES, totals.rows)
    nearest = R.nearest_savings(table, 0.023).first()["review_rate"]
    return _rounded_money(table.withColumn("is_nearest", F.col("review_rate") == F.lit(nearest)))


@query(
    "recall_by_value",
    f"""WITH {SCORED}, {RANKED}, {_CUTS} SELECT review_rate, a.k AS n_reviewed,
          round(caught / CAST(p AS DOUBLE), 6) AS recall_by_count, round(caught_value / v, 6) AS recall_by_value,
          round(caught_value / caught, 6) AS mean_caught, round((v - caught_value) / (p - caught), 6) AS mean_missed
        FROM at_k a JOIN ranked r ON a.k = r.k, totals WHERE review_rate = 0.02""",
)
def recall_by_value(spark, sf):
    return rounded(R.recall_by_value(scored(spark, sf), 0.02))


def _evaluate_sql() -> str:
    rates = []
    for r in RATES:
        name = R.rate_name(r)
        for what in ("recall", "precision"):
            rates.append(
                f"(SELECT round({what}, 6) FROM curve JOIN at_k ON n_flagged = k WHERE at_k.review_rate = CAST({r} AS DOUBLE)) AS {what}_at_{name}"
            )
    return f"""WITH {CURVE}, {_CUTS}, {_area_sql('scored')},
      u AS (SELECT * FROM curve ORDER BY total_cost, n_flagged LIMIT 1),
      w AS (SELECT * FROM curve WHERE review_rate <= 0.02 ORDER BY total_cost, n_flagged LIMIT 1)
      SELECT round(pr_auc, 6) AS pr_auc, round(pr_auc_baseline, 6) AS pr_auc_baseline,
        round(pr_auc / pr_auc_baseline, 6) AS pr_auc_lift, round(roc_auc, 6) AS roc_auc, {', '.join(rates)},
        round(u.savings, 4) AS best_savings_unconstrained, round(u.review_rate, 6) AS best_review_rate_unconstrained,
        round(w.savings, 4) AS best_savings_within_capacity, w.threshold AS best_threshold_within_capacity,
        round(w.recall, 6) AS best_recall_within_capacity FROM area, u, w"""


@query("evaluate_all", _evaluate_sql())
def evaluate_all(spark, sf):
    out = R.evaluate_all(scored(spark, sf), RATES)
    money = ["best_savings_unconstrained", "best_savings_within_capacity"]
    return rounded(out, at=dict.fromkeys(money, 4))


@query(
    "pr_curve",
    f"""WITH {SCORED}, two AS (SELECT event_type AS model, score, label FROM (
            SELECT 'plain' AS event_type, score, label FROM scored UNION ALL
            SELECT 'inverse', -score, label FROM scored)), {_area_sql('two', 'model')},
        t AS (SELECT model, sum(label) AS p FROM two GROUP BY model)
        SELECT model, score AS threshold, round(caught / CAST(seen AS DOUBLE), 6) AS precision,
          round(caught / CAST(p AS DOUBLE), 6) AS recall FROM c JOIN t USING (model)
        UNION ALL SELECT model, NULL, 1.0e0, 0.0e0 FROM t""",
)
def pr_curve(spark, sf):
    s = scored(spark, sf).select("score", "label")
    two = s.withColumn("model", F.lit("plain")).unionByName(
        s.select((-F.col("score")).alias("score"), "label", F.lit("inverse").alias("model"))
    )
    return rounded(R.pr_curve(two, by=["model"]))


_WEEKS = PeriodRules(min_rows=500, min_positives=10, full_rows=2300)


@query(
    "weekly_performance",
    f"""WITH {SCORED}, w AS (SELECT *, strftime(date_trunc('week', ts), '%Y-%m-%d') || '/' ||
          strftime(date_trunc('week', ts) + INTERVAL 6 DAY, '%Y-%m-%d') AS period FROM scored), {_area_sql('w', 'period')}
        SELECT period, rows, positives, round(pr_auc_baseline, 6) AS positive_rate, round(pr_auc, 6) AS pr_auc,
          round(pr_auc / pr_auc_baseline, 6) AS pr_auc_lift, round(roc_auc, 6) AS roc_auc, rows >= 2300 AS is_full_period,
          round(avg(CASE WHEN rows >= 2300 THEN pr_auc / pr_auc_baseline END) OVER (), 6) AS mean_full_lift
        FROM area WHERE rows >= 500 AND positives >= 10""",
)
def weekly_performance(spark, sf):
    weekly = scored(spark, sf).withColumn("period", X.week_label("ts"))
    return rounded(R.period_performance(weekly, "period", rules=_WEEKS))


@query(
    "score_histogram",
    f"""WITH {SCORED}, x AS (SELECT label AS g, score / 500 AS v FROM scored),
        b AS (SELECT g, least(CAST(floor(v / (CAST(1 AS DOUBLE) / 59)) AS BIGINT) + 1, 59) AS bin FROM x WHERE v BETWEEN 0 AND 1)
        SELECT g AS "group", bin, round(CAST(0 AS DOUBLE) + (bin - 1) * (CAST(1 AS DOUBLE) / 59), 6) AS edge, count(*) AS rows,
          round(count(*) / (sum(count(*)) OVER (PARTITION BY g) * (CAST(1 AS DOUBLE) / 59)), 6) AS density FROM b GROUP BY g, bin""",
)
def score_histogram(spark, sf):
    s = scored(spark, sf).withColumn("p", F.col("score") / 500)
    return rounded(R.score_histogram(s, "p", "label"))


@query(
    "prior_baseline",
    f"""WITH {FACTS}, s AS (SELECT *, CASE WHEN sec <= (SELECT quantile_cont(sec, 0.8) FROM facts) THEN 1 ELSE 0 END AS train FROM facts),
        p AS (SELECT avg(label) FILTER (WHERE train = 1) AS score, avg(label) FILTER (WHERE train = 0) AS rate, count(*) FILTER (WHERE train = 0) AS rows,
          CAST(sum(label) FILTER (WHERE train = 0) AS BIGINT) AS positives FROM s)
        SELECT rows, positives, round(rate, 6) AS pr_auc, round(rate, 6) AS pr_auc_baseline, 1.0e0 AS pr_auc_lift,
          0.5e0 AS roc_auc, round(score, 6) AS score FROM p""",
)
def prior_baseline(spark, sf):
    from txrisk.operators.encoding import time_split

    split, _ = time_split(facts(spark, sf), "sec")
    train, valid = split.filter("split = 'train'"), split.filter("split = 'valid'")
    flat = M.prior_scores(train, valid, "label")
    level = flat.agg(F.max("score")).scalar()
    return rounded(R.ranking_metrics(flat).withColumn("score", level))


@query(
    "expanding_folds",
    f"""WITH {FACTS}, e AS (SELECT quantile_cont(sec, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS q FROM facts),
        f AS (SELECT unnest(range(1, 5)) AS fold),
        m AS (SELECT fold, sec, CASE WHEN sec <= q[fold + 1] THEN 'train' WHEN sec <= q[fold + 2] THEN 'valid' END AS role FROM facts, e, f)
        SELECT fold, count(*) FILTER (WHERE role = 'train') AS train_rows, count(*) FILTER (WHERE role = 'valid') AS valid_rows,
          strftime(make_timestamp(min(sec) FILTER (WHERE role = 'valid') * 1000000), '%Y-%m-%d') AS valid_start,
          strftime(make_timestamp(max(sec) FILTER (WHERE role = 'valid') * 1000000), '%Y-%m-%d') AS valid_end
        FROM m GROUP BY fold""",
)
def expanding_folds(spark, sf):
    return M.fold_summary(M.expanding_folds(facts(spark, sf), "sec"), "sec")


# ----------------------------------------------------------------------- drift

# The tables at hand are small; a period counts from this many rows on.
_RULES = DriftRules(min_rows=300, low_confidence_rows=5000)
_WEIGHTS = [
    ("l_quantity", 0.5), ("l_extendedprice", 0.3), ("l_discount", 0.2), ("price_known", 0.1),
    ("quantity_stuck", 0.05), ("not_in_table", 0.25),
]
_THRESHOLD, _EXPECTED = 45.0, 0.1


def _importance(spark):
    return spark.createDataFrame(_WEIGHTS, "feature string, weight double")


def _drift_sql() -> str:
    tall = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, period, {c} AS v FROM lines" for c in DRIFT_FEATURES
    )
    weights = ", ".join(f"('{f}', CAST({w} AS DOUBLE))" for f, w in _WEIGHTS)
    return f"""{LINES}, tall AS ({tall}),
      ref AS (SELECT * FROM tall WHERE period < '1999'), cur AS (SELECT * FROM tall WHERE period >= '1999'),
      edges AS (SELECT feature, list_sort(list_distinct(quantile_cont(v, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e
        FROM ref WHERE v IS NOT NULL GROUP BY feature),
      placed AS (SELECT feature, period, v, len(list_filter(e[2:len(e) - 1], lambda x: x <= v)) AS b, len(e) AS ne FROM tall JOIN edges USING (feature)),
      buckets AS (SELECT unnest(range(0, 10)) AS b),
      rc AS (SELECT feature, b, count(*) AS n FROM placed WHERE period < '1999' AND v IS NOT NULL GROUP BY ALL),
      cc AS (SELECT feature, period, b, count(*) AS n FROM placed WHERE period >= '1999' AND v IS NOT NULL GROUP BY ALL),
      rt AS (SELECT feature, count(v) AS rows_reference, (count(*) - count(v)) / CAST(count(*) AS DOUBLE) AS missing_reference FROM ref GROUP BY feature),
      ct AS (SELECT feature, period, count(v) AS rows_current, (count(*) - count(v)) / CAST(count(*) AS DOUBLE) AS missing_current FROM cur GROUP BY feature, period),
      parts AS (SELECT ct.feature, ct.period, k.b,
          greatest(coalesce(rc.n, 0) / CAST(rows_reference AS DOUBLE), 1e-6) AS r,
          greatest(coalesce(cc.n, 0) / CAST(rows_current AS DOUBLE), 1e-6) AS c
        FROM ct JOIN rt USING (feature) CROSS JOIN buckets k
        LEFT JOIN rc ON rc.feature = ct.feature AND rc.b = k.b
        LEFT JOIN cc ON cc.feature = ct.feature AND cc.period = ct.period AND cc.b = k.b),
      raw AS (SELECT feature, period, sum((c - r) * ln(c / r)) AS psi FROM parts GROUP BY feature, period),
      psi AS (SELECT ct.period, ct.feature, CASE WHEN rows_reference >= 300 AND rows_current >= 300 AND len(e) >= 3 THEN raw.psi END AS psi,
          rows_reference, rows_current, missing_reference, missing_current, missing_current - missing_reference AS missing_change
        FROM ct JOIN rt USING (feature) JOIN edges USING (feature) JOIN raw ON raw.feature = ct.feature AND raw.period = ct.period),
      weights(feature, weight) AS (VALUES {weights}),
      weighted AS (SELECT period, sum(psi * coalesce(weight, 0)) / (SELECT sum(weight) FROM weights) AS weighted_psi
        FROM psi LEFT JOIN weights USING (feature) GROUP BY period)"""


_DRIFT = _drift_sql()
_PSI_COLUMNS = """period, feature, round(psi, 6) AS psi, rows_reference, rows_current, round(missing_reference, 6) AS missing_reference,
    round(missing_current, 6) AS missing_current, round(missing_change, 6) AS missing_change"""

# Empirical distribution gap on all rows, from running counts in value order.
_KS = """per AS (SELECT DISTINCT period FROM cur),
  vals AS (SELECT r.feature, p.period, r.v, 1 AS isref FROM ref r, per p WHERE r.v IS NOT NULL
    UNION ALL SELECT feature, period, v, 0 FROM cur WHERE v IS NOT NULL),
  grp AS (SELECT feature, period, v, sum(isref) AS nr, sum(1 - isref) AS nc FROM vals GROUP BY ALL),
  cum AS (SELECT feature, period, sum(nr) OVER w / CAST(sum(nr) OVER p AS DOUBLE) AS fr, sum(nc) OVER w / CAST(sum(nc) OVER p AS DOUBLE) AS fc
    FROM grp WINDOW w AS (PARTITION BY feature, period ORDER BY v ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY feature, period)),
  ks0 AS (SELECT feature, period, max(abs(fr - fc)) AS ks FROM cum GROUP BY ALL),
  ks AS (SELECT k.feature, k.period, CASE WHEN rows_reference >= 300 AND rows_current >= 300 THEN ks END AS ks
    FROM ks0 k JOIN rt USING (feature) JOIN ct ON ct.feature = k.feature AND ct.period = k.period)"""


def _psi(spark, sf):
    reference, current = lines_by_year(spark, sf)
    return D.psi_by_period(reference, current, DRIFT_FEATURES, "period", _RULES)


@query(
    "missing_rate",
    f"""WITH {_DRIFT} SELECT feature, round(avg(CASE WHEN v IS NULL THEN 1.0e0 ELSE 0.0e0 END), 6) AS missing_rate FROM cur GROUP BY feature""",
)
def missing_rate(spark, sf):
    return rounded(D.missing_rate(lines_by_year(spark, sf)[1], DRIFT_FEATURES))


@query("psi", f"WITH {_DRIFT} SELECT {_PSI_COLUMNS} FROM psi")
def psi(spark, sf):
    return rounded(_psi(spark, sf))


@query("ks_statistic", f"WITH {_DRIFT}, {_KS} SELECT feature, period, round(ks, 6) AS ks FROM ks")
def ks_statistic(spark, sf):
    reference, current = lines_by_year(spark, sf)
    return rounded(D.ks_by_period(reference, current, DRIFT_FEATURES, "period", _RULES))


_BAND = "CASE WHEN psi IS NULL THEN 'unknown' WHEN psi < 0.10 THEN 'stable' WHEN psi < 0.25 THEN 'moderate' ELSE 'significant' END"


@query(
    "drift_by_period",
    f"""WITH {_DRIFT}, {_KS} SELECT p.period, p.feature, round(psi, 6) AS psi, round(ks, 6) AS ks, {_BAND} AS band, rows_reference, rows_current,
          rows_current < 5000 AS low_confidence, round(missing_reference, 6) AS missing_reference,
          round(missing_current, 6) AS missing_current, round(missing_change, 6) AS missing_change
        FROM psi p JOIN ks k ON k.feature = p.feature AND k.period = p.period""",
)
def drift_by_period(spark, sf):
    reference, current = lines_by_year(spark, sf)
    return rounded(D.compare_features(reference, current, DRIFT_FEATURES, "period", _RULES))


@query("weighted_drift", f"WITH {_DRIFT} SELECT period, round(weighted_psi, 6) AS weighted_psi FROM weighted")
def weighted_drift(spark, sf):
    return rounded(D.weighted_drift(_psi(spark, sf), _importance(spark)))


_SCORE_DRIFT = f"""{_DRIFT},
  sig AS (SELECT period, count(*) FILTER (WHERE psi > 0.25) AS features_significant, count(*) FILTER (WHERE psi > 0.25 AND feature IN
    (SELECT feature FROM weights ORDER BY weight DESC, feature LIMIT 20)) AS top_features_significant FROM psi GROUP BY period),
  sd AS (SELECT period, count(*) AS rows, avg(l_quantity) AS score_mean, quantile_cont(l_quantity, 0.5) AS score_p50,
    quantile_cont(l_quantity, 0.9) AS score_p90, quantile_cont(l_quantity, 0.99) AS score_p99,
    avg(CASE WHEN l_quantity >= {_THRESHOLD} THEN 1.0e0 ELSE 0.0e0 END) AS alert_rate FROM lines WHERE period >= '1999' GROUP BY period HAVING count(*) >= 300),
  score_drift AS (SELECT sd.*, alert_rate / CAST({_EXPECTED} AS DOUBLE) AS alert_rate_ratio, weighted_psi, features_significant, top_features_significant
    FROM sd JOIN weighted USING (period) JOIN sig USING (period))"""


def _score_drift(spark, sf):
    reference, current = lines_by_year(spark, sf)
    drift = D.psi_by_period(reference, current, DRIFT_FEATURES, "period", _RULES)
    return D.score_drift(
        current, "period", drift, _importance(spark), _THRESHOLD, _EXPECTED, "l_quantity", _RULES
    )


@query(
    "score_drift",
    f"""WITH {_SCORE_DRIFT} SELECT period, rows, round(score_mean, 6) AS score_mean, round(score_p50, 6) AS score_p50, round(score_p90, 6) AS score_p90,
          round(score_p99, 6) AS score_p99, round(alert_rate, 6) AS alert_rate, round(alert_rate_ratio, 6) AS alert_rate_ratio,
          round(weighted_psi, 6) AS weighted_psi, features_significant, top_features_significant FROM score_drift""",
)
def score_drift(spark, sf):
    return rounded(_score_drift(spark, sf))


@query(
    "drift_verdict",
    f"""WITH {_SCORE_DRIFT}, v AS (SELECT max(weighted_psi) AS worst_weighted_psi, arg_max(alert_rate_ratio, period) AS alert_rate_ratio,
          arg_max(top_features_significant, period) AS top_features_significant FROM score_drift)
        SELECT round(worst_weighted_psi, 6) AS worst_weighted_psi, round(alert_rate_ratio, 6) AS alert_rate_ratio, top_features_significant,
          CASE WHEN worst_weighted_psi > 0.15 OR top_features_significant >= 3 THEN 'RETRAIN'
            WHEN worst_weighted_psi > 0.05 OR abs(alert_rate_ratio - 1) > 0.5 THEN 'WATCH' ELSE 'OK' END AS verdict FROM v""",
)
def drift_verdict(spark, sf):
    return rounded(D.drift_verdict(_score_drift(spark, sf), _RULES))


@query(
    "top_drift",
    f"""WITH {_DRIFT} SELECT period, feature, round(psi, 6) AS psi, round(missing_reference, 6) AS missing_reference, round(missing_current, 6) AS missing_current
        FROM psi WHERE rows_current >= 500 ORDER BY psi.psi DESC NULLS LAST, feature, period LIMIT 20""",
)
def top_drift(spark, sf):
    drift = _psi(spark, sf).withColumn("low_confidence", F.col("rows_current") < 500)
    return rounded(D.top_drift(drift, 20))


@query(
    "psi_grid",
    f"""WITH {_DRIFT} SELECT feature, {', '.join(f"round(max(psi) FILTER (WHERE period = '{y}'), 6) AS " + chr(34) + str(y) + chr(34) for y in (1999, 2000, 2001))}
        FROM psi GROUP BY feature""",
)
def psi_grid(spark, sf):
    drift = _psi(spark, sf)
    periods = sorted(r[0] for r in drift.select("period").distinct().collect())  # one row per period
    return rounded(D.psi_grid(drift, _importance(spark), periods))
