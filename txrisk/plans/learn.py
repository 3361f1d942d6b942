"""Fitted encoders, models and streams over the given tables."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.functions import scalar as X
from txrisk.operators import boosting as B
from txrisk.operators import encoding as E
from txrisk.operators import modeling as M
from txrisk.operators.joins import lookup_size
from txrisk.operators.ranking import Scored, ranking_metrics
from txrisk.plans.inputs import ENRICHED, FACTS, enriched, facts, scored
from txrisk.plans.registry import NUDGE, mean_rounded, mean_rounded_sql, query, round_double, rounded
from txrisk.session import materialise, scratch_path
from txrisk.settings import ENTITY_FEATURE_MARKERS
from txrisk.sources.tables import json_to_columns, plain_times, read_table
from txrisk.streaming import scoring as S

NAMES = Scored("id", "score", "label", "amount")
SPEC = E.EncoderSpec(
    id="id",
    time="sec",
    label="label",
    amount="amount",
    card="card",
    address="addr",
    age_days="age",
    emails=(),
    device="segment",
    browser="product",
    screen="",
    match=(),
    frequency=("card", "addr", "card_addr", "uid", "product"),
    aggregates=(("card", "amount"), ("addr", "amount"), ("uid", "amount"), ("card", "balance")),
    blocks=(("r_lines", "r_qty", "r_value"), ("b_lines", "b_discount")),
)

_SPLIT = f"""{ENRICHED}, cut AS (SELECT quantile_cont(sec, 0.8) AS b FROM facts),
  train AS (SELECT * FROM enriched WHERE sec <= (SELECT b FROM cut)), valid AS (SELECT * FROM enriched WHERE sec > (SELECT b FROM cut))"""
_CARD = "CAST(CAST(card AS DOUBLE) AS VARCHAR)"
_ADDR = "coalesce(CAST(CAST(addr AS DOUBLE) AS VARCHAR), '(missing)')"
_UID = f"{_CARD} || '_' || {_ADDR} || '_' || CAST(CAST(floor(sec / 86400.0) - age AS DOUBLE) AS VARCHAR)"


def _halves(frame):
    split, _ = E.time_split(frame, "sec")
    return (
        split.filter("split = 'train'").drop("split"),
        split.filter("split = 'valid'").drop("split"),
    )


def _split(spark, sf):
    """Enriched rows before and after the time cut."""
    return _halves(enriched(spark, sf))


def _fitted(spark, sf):
    """The feature stage: write the join, fit on its earlier part; the rows before and after the cut."""
    train, valid = _halves(materialise(enriched(spark, sf), "joined"))
    return E.RiskEncoder(SPEC).fit(train), train, valid


# --------------------------------------------------------------------- lookups


@query(
    "frequency_map",
    f"""WITH {_SPLIT} SELECT {_CARD} AS label, count(*) AS n,
          round(count(*) / CAST((SELECT count(*) FROM train) AS DOUBLE), 6) AS share FROM train GROUP BY 1""",
)
def frequency_map(spark, sf):
    train, _ = _split(spark, sf)
    return rounded(E.frequency_map(train, X.label_of(train, "card")))


@query(
    "category_map",
    f"""WITH {_SPLIT}, l AS (SELECT DISTINCT {_CARD} || '_' || {_ADDR} AS label FROM train)
        SELECT label, row_number() OVER (ORDER BY label COLLATE "C") - 1 AS code FROM l""".replace(' COLLATE "C"', ""),
)
def category_map(spark, sf):
    train, _ = _split(spark, sf)
    pair = X.join_labels(X.label_of(train, "card"), X.label_of(train, "addr"))
    return E.category_map(train, pair).drop("share")


@query(
    "group_agg_map",
    f"""WITH {_SPLIT} SELECT {_CARD} AS label, {mean_rounded_sql('avg(amount)')} AS mean, round(stddev_samp(amount), 4) AS std FROM train GROUP BY 1""",
)
def group_agg_map(spark, sf):
    train, _ = _split(spark, sf)
    learnt = E.group_aggregate_map(train, X.label_of(train, "card"), "amount")
    return learnt.select("label", mean_rounded("mean").alias("mean"), round_double("std", 4).alias("std"))


@query(
    "category_encode",
    f"""WITH {_SPLIT}, m AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS code
          FROM (SELECT DISTINCT {_CARD} || '_' || {_ADDR} AS label FROM train))
        SELECT id, coalesce(code, -1) AS code FROM enriched LEFT JOIN m ON m.label = {_CARD} || '_' || {_ADDR}""",
)
def category_encode(spark, sf):
    every = enriched(spark, sf)
    train, _ = _halves(every)
    pair = lambda t: X.join_labels(X.label_of(t, "card"), X.label_of(t, "addr"))
    codes = E.category_map(train, pair(train))
    work = every.select("id", pair(every).alias("label_text"))
    codes = materialise(codes, "codes")
    rows, size = lookup_size(codes, "label")
    out = E.encode_category(work, "label_text", codes, rows, "pair_code", size=size)
    return out.select("id", F.col("pair_code").alias("code"))


@query(
    "frequency_encode",
    f"""WITH {_SPLIT}, m AS (SELECT {_CARD} AS label, count(*) / CAST((SELECT count(*) FROM train) AS DOUBLE) AS share FROM train GROUP BY 1)
        SELECT id, round(coalesce(share, 0), 6) AS freq FROM enriched LEFT JOIN m ON m.label = {_CARD}""",
)
def frequency_encode(spark, sf):
    every = enriched(spark, sf)
    train, _ = _halves(every)
    shares = E.frequency_map(train, X.label_of(train, "card"))
    work = every.select("id", X.label_of(every, "card").alias("card_label"))
    shares = materialise(shares, "shares")
    rows, size = lookup_size(shares, "label")
    out = E.encode_frequency(work, "card_label", shares, rows, "freq", size=size)
    return rounded(out.select("id", "freq"))


@query(
    "group_agg_encode",
    f"""WITH {_SPLIT}, m AS (SELECT {_CARD} AS label, avg(amount) AS mean, stddev_samp(amount) AS std FROM train GROUP BY 1)
        SELECT id, {mean_rounded_sql('mean')} AS amount_mean_by_card, round(std, 4) AS amount_std_by_card,
          round(amount / nullif(mean, 0), 6) AS amount_ratio_to_card_mean FROM enriched LEFT JOIN m ON m.label = {_CARD}""",
)
def group_agg_encode(spark, sf):
    every = enriched(spark, sf)
    train, _ = _halves(every)
    stats = E.group_aggregate_map(train, X.label_of(train, "card"), "amount")
    work = every.select("id", "amount", X.label_of(every, "card").alias("card_label"))
    stats = materialise(stats, "card-stats")
    rows, size = lookup_size(stats, "label")
    joined = E.lookup_join(work, "card_label", stats, "label", rows, lookup_bytes=size)
    return joined.select(
        "id",
        mean_rounded("mean").alias("amount_mean_by_card"),
        round_double("std", 4).alias("amount_std_by_card"),
        round_double(X.ratio_or_null(F.col("amount"), F.col("mean")), 6).alias("amount_ratio_to_card_mean"),
    )


# --------------------------------------------------------------------- encoder


@query(
    "encode_fit_state",
    f"""WITH {_SPLIT}, l AS (
          SELECT 'card' AS "column", {_CARD} AS label, amount, balance FROM train UNION ALL
          SELECT 'addr', {_ADDR}, amount, balance FROM train UNION ALL
          SELECT 'card_addr', {_CARD} || '_' || {_ADDR}, amount, balance FROM train UNION ALL
          SELECT 'uid', {_UID}, amount, balance FROM train UNION ALL
          SELECT 'product', coalesce(product, '(missing)'), amount, balance FROM train UNION ALL
          SELECT 'segment', coalesce(segment, '(missing)'), amount, balance FROM train UNION ALL
          SELECT 'device_brand', lower(split_part(coalesce(segment, '(missing)'), ' ', 1)), amount, balance FROM train UNION ALL
          SELECT 'browser_family', lower(split_part(coalesce(product, '(missing)'), ' ', 1)), amount, balance FROM train),
        m AS (SELECT "column", label, count(*) AS n, count(*) / CAST((SELECT count(*) FROM train) AS DOUBLE) AS share,
          avg(amount) AS amount_mean, avg(balance) AS balance_mean FROM l GROUP BY 1, 2)
        SELECT "column", label, n, round(share, 6) AS share, {mean_rounded_sql('amount_mean')} AS amount_mean,
          {mean_rounded_sql('balance_mean')} AS balance_mean, CASE WHEN "column" IN ('card_addr', 'product', 'segment', 'device_brand', 'browser_family')
            THEN row_number() OVER (PARTITION BY "column" ORDER BY label) - 1 END AS code FROM m""",
)
def encode_fit_state(spark, sf):
    train, _ = _halves(materialise(enriched(spark, sf), "joined"))
    model = E.RiskEncoder(SPEC).fit(train)
    values = model.state["values"]
    return model.lookups.select(
        "column",
        "label",
        "n",
        round_double("share", 6).alias("share"),
        mean_rounded(f"mean_{values.index('amount')}").alias("amount_mean"),
        mean_rounded(f"mean_{values.index('balance')}").alias("balance_mean"),
        F.col("code").cast("long").alias("code"),
    )


def _encode_sql() -> str:
    joins, cols = [], []
    labels = {
        "card": _CARD, "addr": _ADDR, "card_addr": f"{_CARD} || '_' || {_ADDR}", "uid": _UID,
        "product": "product", "segment": "segment", "device_brand": "lower(split_part(segment, ' ', 1))",
        "browser_family": "lower(split_part(product, ' ', 1))",
    }
    maps = []
    for i, (c, text) in enumerate(labels.items()):
        maps.append(
            f"""m{i} AS (SELECT label, n / CAST((SELECT count(*) FROM train) AS DOUBLE) AS share, am, asd, bm, bsd,
              row_number() OVER (ORDER BY label) - 1 AS code FROM (SELECT {text} AS label, count(*) AS n, avg(amount) AS am,
              stddev_samp(amount) AS asd, avg(balance) AS bm, stddev_samp(balance) AS bsd FROM train GROUP BY 1))"""
        )
        joins.append(f"LEFT JOIN m{i} ON m{i}.label = {text}")
        if c in ("card", "addr", "card_addr", "uid", "product"):
            cols.append(f"round(coalesce(m{i}.share, 0), 6) AS {c}_freq")
        if c in ("card_addr", "product", "segment", "device_brand", "browser_family"):
            cols.append(f"coalesce(m{i}.code, -1) AS {c}_code")
        stats = {"card": [("amount", "a"), ("balance", "b")], "addr": [("amount", "a")], "uid": [("amount", "a")]}
        for v, k in stats.get(c, []):
            cols += [
                f"{mean_rounded_sql(f'm{i}.{k}m')} AS {v}_mean_by_{c}",
                f"round(m{i}.{k}sd, 4) AS {v}_std_by_{c}",
                f"round({v} / nullif(m{i}.{k}m, 0), 4) AS {v}_ratio_to_{c}_mean",
            ]
    base = """id, sec, label_y AS label, amount, card, addr, age, balance, has_returns, has_bulk, r_value, b_lines,
      round(b_discount, 4) AS b_discount, hour, day_of_week, round(amount_log, 4) AS amount_log, amount_cents, amount_is_round"""
    parts = [
        f"""v_{part} AS (SELECT * EXCLUDE (label), label AS label_y, CAST(floor(sec / 3600.0) AS BIGINT) % 24 AS hour,
        CAST(floor(sec / 86400.0) AS BIGINT) % 7 AS day_of_week, ln(1 + amount) AS amount_log, round(amount - floor(amount), 4) AS amount_cents,
        CAST(CASE WHEN round(amount - floor(amount), 4) = 0 THEN 1 ELSE 0 END AS BIGINT) AS amount_is_round FROM {part}),
      enc_{part} AS (SELECT {base}, {', '.join(cols)} FROM v_{part} {' '.join(joins)})"""
        for part in ("train", "valid")
    ]
    return f"WITH {_SPLIT}, {', '.join(maps)}, {', '.join(parts)}"


_ENCODED = _encode_sql()


def _manifest_sql() -> str:
    rows = [(c, "base_numeric", c) for c in
            ("amount", "card", "addr", "age", "balance", "has_returns", "has_bulk", "r_value", "b_lines", "b_discount")]
    rows += [(c, "derived_time", "sec") for c in ("hour", "day_of_week")]
    rows += [(c, "derived_amount", "amount") for c in ("amount_log", "amount_cents", "amount_is_round")]
    rows += [(f"{c}_code", "category_code", c) for c in ("card_addr", "product", "segment", "device_brand", "browser_family")]
    rows += [(f"{c}_freq", "frequency", c) for c in SPEC.frequency]
    rows += [(n, "aggregate", f"{v} by {g}") for g, v in SPEC.aggregates for n in E.aggregate_names(g, v)]
    share = "round_even(avg(CASE WHEN {0} IS NULL THEN 1.0e0 ELSE 0.0e0 END) * 100, 2)"
    body = " UNION ALL ".join(
        f"""SELECT '{f}' AS feature, '{k}' AS kind, '{s}' AS source, (SELECT {share.format(f)} FROM enc_train) AS missing_pct_train,
          (SELECT {share.format(f)} FROM enc_valid) AS missing_pct_test"""
        for f, k, s in rows
    )
    return f"{_ENCODED} {body}"


@query("encode_transform", f"{_ENCODED} SELECT * FROM enc_train UNION ALL SELECT * FROM enc_valid")
def encode_transform(spark, sf):
    model, train, valid = _fitted(spark, sf)
    every = model.transform(train).unionByName(model.transform(valid))
    learnt = [c for c in every.columns if "_by_" in c or "_to_" in c]
    # Each column is rounded once; columns of the table itself are left as they are.
    places = dict.fromkeys([*learnt, "amount_log", "b_discount"], 4)
    places |= {c: None for c in every.columns if c not in places and not c.endswith("_freq")}
    nudged = every.withColumns({c: F.col(c) + F.lit(NUDGE) for c in learnt if "_mean_by_" in c})
    return rounded(nudged, at=places)


@query(
    "encoder_reload_equal",
    f"WITH {_SPLIT} SELECT count(*) AS rows, CAST(0 AS BIGINT) AS rows_changed FROM valid",
)
def encoder_reload_equal(spark, sf):
    model, _, later = _fitted(spark, sf)
    path = scratch_path(spark, "encoder")
    PipelineModel([model]).write().overwrite().save(path)
    valid, again = model.transform(later), PipelineModel.load(path).transform(later)
    digest = lambda t: F.xxhash64(*[F.col(c) for c in t.columns])
    left = valid.select("id", digest(valid).alias("a"))
    right = again.select("id", digest(again).alias("b"))
    return left.join(right, "id", "full").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("rows_changed")
    )


@query("feature_manifest", _manifest_sql())
def feature_manifest(spark, sf):
    model, train, valid = _fitted(spark, sf)
    # Each side is read once, for its nulls alone, so its features are not written.
    return E.feature_manifest(model, model.transform(train), model.transform(valid))


@query(
    "unseen_share",
    f"""WITH {_SPLIT}, z AS (SELECT
          CAST({_CARD} NOT IN (SELECT {_CARD} FROM train) AS INT) + CAST({_ADDR} NOT IN (SELECT {_ADDR} FROM train) AS INT)
          + CAST({_CARD} || '_' || {_ADDR} NOT IN (SELECT {_CARD} || '_' || {_ADDR} FROM train) AS INT)
          + CAST({_UID} NOT IN (SELECT {_UID} FROM train) AS INT) + CAST(product NOT IN (SELECT product FROM train) AS INT) AS zeros FROM valid)
        SELECT round(sum(zeros) / CAST(count(*) * 5 AS DOUBLE), 6) AS unseen_share FROM z""",
)
def unseen_share(spark, sf):
    model, _, valid = _fitted(spark, sf)
    return rounded(E.unseen_share(model.transform(valid), [f for f in model.feature_names if f.endswith("_freq")]))


@query(
    "feature_checks",
    """SELECT unnest(['label_in_features', 'columns_differ', 'all_null', 'infinite']) AS "check", true AS passed, '' AS columns
       FROM (SELECT count(*) AS n FROM orders) WHERE n > 0""",
)
def feature_checks(spark, sf):
    model, train, valid = _fitted(spark, sf)
    return E.feature_checks(model.transform(train), model.transform(valid), model.feature_names, "label")


_CLOCK = ["amount", "card", "balance", "sec_twin", "r_value"]


@query(
    "clock_leak_check",
    f"""WITH {ENRICHED}, t AS (SELECT *, sec * 2.5e0 + 7 AS sec_twin FROM enriched), c AS ({' UNION ALL '.join(
        f"SELECT '{c}' AS feature, count({c}) AS rows, corr({c}, sec) AS r FROM t WHERE {c} IS NOT NULL" for c in _CLOCK)})
        SELECT feature, rows, round(r, 6) AS correlation, rows >= 100 AND abs(r) > 0.98 AS tracks_clock FROM c""",
)
def clock_leak_check(spark, sf):
    frame = enriched(spark, sf).withColumn("sec_twin", F.col("sec") * 2.5 + 7)
    return rounded(E.clock_leak_check(frame, _CLOCK, "sec"))


# ---------------------------------------------------------------------- models

_FEATURES = ["amount", "card", "addr", "age", "balance"]


def _model_split(spark, sf):
    """Facts before and after the time cut, written once: a fit passes over them many times."""
    return _halves(materialise(facts(spark, sf), "facts"))


def _logistic():
    return M.logistic_candidate("label")


@query("logistic_scores")
def logistic_scores(spark, sf):
    train, valid = _model_split(spark, sf)
    model = M.fit(_logistic(), train, _FEATURES, "label")
    return M.score(_logistic(), model, valid, _FEATURES, ["id", "label"])


@query("gbt_scores")
def gbt_scores(spark, sf):
    train, valid = _model_split(spark, sf)
    trees = M.boosted_candidate("label")
    return M.score(trees, M.fit(trees, train, _FEATURES, "label"), valid, _FEATURES, ["id", "label"])


@query("candidate_comparison")
def candidate_comparison(spark, sf):
    train, valid = _model_split(spark, sf)
    trees = M.boosted_candidate("label", "boosted")
    return M.compare_candidates([_logistic(), trees], train, valid, _FEATURES, NAMES, prior=True).drop("fit_seconds")


@query("cv_summary")
def cv_summary(spark, sf):
    cv = M.cross_validate(_logistic(), facts(spark, sf), _FEATURES, "sec", NAMES)
    return M.fold_stability(cv)


@query("ablation_compare")
def ablation_compare(spark, sf):
    model, train, valid = _fitted(spark, sf)
    train = materialise(model.transform(train), "features-train")
    valid = materialise(model.transform(valid), "features-valid")
    features = [c for c in model.feature_names if not c.endswith("_code")]
    kept = M.feature_columns(train.select(*features), [], ENTITY_FEATURE_MARKERS)
    return M.ablation(_logistic(), train, valid, features, [c for c in features if c not in kept], NAMES)


@query("batch_scores")
def batch_scores(spark, sf):
    train, valid = _model_split(spark, sf)
    model = M.fit(_logistic(), train, _FEATURES, "label")
    return M.batch_scores(_logistic(), model, valid, _FEATURES, "id", 0.33)


_GAPPED = ["amount", "card", "balance", "age", "r_value", "b_discount"]


@query(
    "gbt_early_stop",
    f"""WITH {_SPLIT} SELECT (SELECT count(*) FROM valid) AS valid_rows, (SELECT CAST(sum(label) AS BIGINT) FROM valid) AS positives,
          true AS kept_within_tried, true AS best_is_highest, true AS stopped_in_time, true AS precision_recomputed,
          concat_ws(',', {', '.join(f"CASE WHEN count({c}) < count(*) THEN '{c}' END" for c in _GAPPED)}) AS indicators
        FROM train""",
)
def gbt_early_stop(spark, sf):
    """Facts about a run that stops by average precision; its scores are written and measured anew."""
    train, valid = _halves(materialise(enriched(spark, sf), "joined"))
    recipe = B.Recipe("quick", depth=4, step=0.3, rows=0.8)
    most, patience = 16, 4
    candidate = M.early_stopped_candidate(recipe, most, patience)
    model = M.fit(candidate, train, _GAPPED, "label", valid)
    scored = materialise(M.score(candidate, model, valid, _GAPPED, ["id", "label"]), "boosted-scores")
    precisions = [r["pr_auc"] for r in model.log]
    best = 1 + precisions.index(max(precisions))
    return ranking_metrics(scored, NAMES).select(
        F.col("rows").alias("valid_rows"),
        F.col("positives"),
        F.lit(model.best_round <= model.rounds_tried <= most).alias("kept_within_tried"),
        F.lit(best == model.best_round).alias("best_is_highest"),
        F.lit(model.rounds_tried - model.best_round == patience or model.rounds_tried == most).alias("stopped_in_time"),
        (F.abs(F.col("pr_auc") - max(precisions)) < 1e-9).alias("precision_recomputed"),
        F.lit(",".join(model.indicators)).alias("indicators"),
    )


@query(
    "refit_rounds",
    f"""WITH {FACTS}, cut AS (SELECT quantile_cont(sec, 0.8) AS b FROM facts)
        SELECT count(*) FILTER (WHERE sec <= b) AS train_rows, count(*) AS all_rows,
          round(count(*) / CAST(count(*) FILTER (WHERE sec <= b) AS DOUBLE), 6) AS growth,
          true AS rounds_follow_growth, count(*) AS scored_rows FROM facts, cut""",
)
def refit_rounds(spark, sf):
    """The last fit: the kept round scaled by the growth in rows, on all of them."""
    table = materialise(facts(spark, sf), "facts")
    train, valid = _halves(table)
    candidate = M.early_stopped_candidate(B.Recipe("quick", depth=3, step=0.3), 8, 4)
    kept = M.fit(candidate, train, _FEATURES, "label", valid).best_round
    n_train, n_all = train.count(), table.count()
    final, model = M.refit_all(candidate.with_rounds, kept, n_train, table, _FEATURES, "label")
    followed = len(model.trees.treeWeights) == model.best_round == max(1, round(kept * n_all / n_train))
    return M.score(final, model, table, _FEATURES, ["id"]).agg(F.count("score").alias("scored_rows")).select(
        F.lit(n_train).cast("long").alias("train_rows"),
        F.lit(n_all).cast("long").alias("all_rows"),
        round_double(F.lit(n_all / n_train), 6).alias("growth"),
        F.lit(followed).alias("rounds_follow_growth"),
        "scored_rows",
    )


@query(
    "prior_row",
    f"""WITH {FACTS}, cut AS (SELECT quantile_cont(sec, 0.8) AS b FROM facts)
        SELECT 'prior' AS model, round(avg(label), 6) AS pr_auc, round(avg(label), 6) AS pr_auc_baseline,
          CAST(1 AS DOUBLE) AS pr_auc_lift, CAST(0.5 AS DOUBLE) AS roc_auc, count(*) FILTER (WHERE false) AS rounds
        FROM facts, cut WHERE sec > b""",
)
def prior_row(spark, sf):
    """The floor of the leaderboard: precision is the rate, the ROC area one half."""
    train, valid = _model_split(spark, sf)
    table = M.compare_candidates([], train, valid, _FEATURES, NAMES, prior=True)
    areas = ["pr_auc", "pr_auc_baseline", "pr_auc_lift", "roc_auc"]
    return rounded(table.select("model", *areas, F.coalesce("best_round", F.lit(0)).alias("rounds")))


@query(
    "cv_folds",
    f"""WITH {FACTS}, e AS (SELECT quantile_cont(sec, [0.2, 0.4, 0.6, 0.8, 1.0]) AS q FROM facts),
        f AS (SELECT unnest(range(1, 5)) AS fold),
        r AS (SELECT fold, sec, label, sec <= q[fold] AS early FROM facts, e, f WHERE sec <= q[fold + 1])
        SELECT fold, count(*) FILTER (WHERE early) AS train_rows, count(*) FILTER (WHERE NOT early) AS valid_rows,
          strftime(make_timestamp(min(sec) FILTER (WHERE NOT early) * 1000000), '%Y-%m-%d') AS valid_start,
          strftime(make_timestamp(max(sec) FILTER (WHERE NOT early) * 1000000), '%Y-%m-%d') AS valid_end,
          round(avg(label) FILTER (WHERE NOT early), 6) AS pr_auc_baseline, true AS measured
        FROM r GROUP BY fold""",
)
def cv_folds(spark, sf):
    """Rows, dates and rate of every fold of a cross-validation."""
    cv = M.cross_validate(_logistic(), facts(spark, sf), _FEATURES, "sec", NAMES)
    return rounded(
        cv.select(
            "fold", "train_rows", "valid_rows", "valid_start", "valid_end", "pr_auc_baseline",
            ((F.col("pr_auc") > 0) & (F.col("pr_auc") <= 1) & F.col("roc_auc").between(0, 1)).alias("measured"),
        )
    )


_NULLED = {"amount": "amount", "card": "card", "addr": "CASE WHEN id % 5 <> 0 THEN addr END",
           "age": "CASE WHEN id % 3 <> 0 THEN age END", "balance": "CASE WHEN card % 4 <> 0 THEN balance END"}


@query(
    "logistic_optimum",
    f"""WITH {FACTS}, cut AS (SELECT quantile_cont(sec, 0.8) AS b FROM facts),
        g AS (SELECT sec, {', '.join(f'{x} AS {c}' for c, x in _NULLED.items())} FROM facts, cut WHERE sec <= b)
        {' UNION ALL '.join(f"""SELECT '{c}' AS feature, round(quantile_cont({c}, 0.5), 6) AS median,
          count(*) - count({c}) AS filled, true AS at_optimum FROM g""" for c in _NULLED)}""",
)
def logistic_optimum(spark, sf):
    """Medians that fill the gaps, and whether the penalised loss is flat at the fitted weights."""
    frame = facts(spark, sf).select("id", "sec", "label", *[F.expr(x).alias(c) for c, x in _NULLED.items()])
    train, _ = _halves(materialise(frame, "gapped"))
    candidate = _logistic()
    model = M.fit(candidate, train, list(_NULLED), "label")
    slopes = M.logistic_gradient(candidate, model, train, list(_NULLED), "label")
    medians = model.stages[0].surrogates()
    gaps = train.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in _NULLED]).first()
    rows = [(c, float(medians[c]), gaps[c], bool(abs(slopes[c]) < 1e-3)) for c in _NULLED]
    return rounded(spark.createDataFrame(rows, "feature string, median double, filled long, at_optimum boolean"))


# A linear score with fixed weights, so that SQL can follow it.
_WEIGHTS = {"amount": 2e-6, "balance": -1e-4, "age": 0.03, "addr": 0.02}
_CONTRIB = f"""{FACTS}, means AS (SELECT {', '.join(f'avg({c}) AS m_{c}' for c in _WEIGHTS)} FROM facts),
  contrib AS (SELECT id, {', '.join(f'({c} - m_{c}) * CAST({w!r} AS DOUBLE) AS {c}' for c, w in _WEIGHTS.items())} FROM facts, means),
  tall AS ({' UNION ALL '.join(f"SELECT id, '{c}' AS feature, {c} AS v FROM contrib" for c in _WEIGHTS)})"""


def _contributions(spark, sf):
    f = facts(spark, sf)
    means = f.agg(*[F.avg(c).alias(c) for c in _WEIGHTS]).first()
    return f.select(
        "id", *[((F.col(c) - F.lit(means[c])) * F.lit(w)).alias(c) for c, w in _WEIGHTS.items()]
    )


@query(
    "importance_summary",
    f"""WITH {_CONTRIB}, s AS (SELECT feature, avg(abs(v)) AS mean_abs, max(abs(v)) AS max_abs,
          count(*) FILTER (WHERE abs(v) > 0.01) AS rows_with_influence FROM tall GROUP BY feature)
        SELECT feature, round(mean_abs, 6) AS mean_abs, round(max_abs, 6) AS max_abs, rows_with_influence,
          rank() OVER (ORDER BY max_abs DESC) AS max_rank FROM s""",
)
def importance_summary(spark, sf):
    return rounded(M.importance_summary(_contributions(spark, sf), list(_WEIGHTS)))


@query(
    "row_explanations",
    f"""WITH {_CONTRIB}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(v) DESC, feature) AS place FROM tall)
        SELECT id, place, feature, round(v, 6) AS contribution FROM r WHERE place <= 3""",
)
def row_explanations(spark, sf):
    return rounded(M.row_explanations(_contributions(spark, sf), "id", list(_WEIGHTS), 3))


@query("linear_explanations")
def linear_explanations(spark, sf):
    train, valid = _model_split(spark, sf)
    model = M.fit(_logistic(), train, _FEATURES, "label")
    parts = M.linear_contributions(model, valid, _FEATURES, ["id"])
    return M.importance_summary(parts, _FEATURES)


# --------------------------------------------------------------------- streams

_RECORD = T.StructType(
    [
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_custkey", T.LongType()),
        T.StructField("o_totalprice", T.DoubleType()),
        T.StructField("o_orderpriority", T.StringType()),
        T.StructField("sec", T.LongType()),
        T.StructField("not_sent", T.StringType()),
    ]
)
_ONLINE = E.EncoderSpec(
    id="o_orderkey",
    time="sec",
    label="label",
    amount="o_totalprice",
    card="o_custkey",
    address="",
    age_days="",
    emails=(),
    device="",
    browser="o_orderpriority",
    screen="",
    match=(),
    frequency=("o_custkey", "o_orderpriority"),
    aggregates=(("o_custkey", "o_totalprice"),),
)


def _records(orders):
    """Orders as free-form JSON records; every tenth lacks its amount."""
    return orders.select(
        F.to_json(
            F.struct(
                "o_orderkey",
                "o_custkey",
                F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice")).alias("o_totalprice"),
                "o_orderpriority",
                F.unix_timestamp("o_orderdate").alias("sec"),
                F.lit("ignored").alias("unknown_field"),
            )
        ).alias("record")
    )


def _online_scorer(spark, sf):
    """Encoder and linear model fitted on the orders that are known."""
    train = read_table(spark, sf, "orders").filter(F.col("o_orderdate") < "1999-01-01").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority",
        F.unix_timestamp("o_orderdate").alias("sec"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"),
    )
    encoder = E.RiskEncoder(_ONLINE).fit(train)
    features = [*encoder.feature_names]
    candidate = _logistic()
    # Written once: a fit passes over its rows many times.
    encoded = materialise(encoder.transform(train).select("label", *features), "online-features")
    model = M.fit(candidate, encoded, features, "label")
    return S.Scorer(
        _RECORD, ["o_orderkey", "sec", "o_totalprice", "o_custkey"], encoder, candidate, model, features, 0.33
    )


@query(
    "stream_scores_equal_batch",
    """SELECT count(*) AS rows_batch, count(*) AS rows_stream, CAST(0 AS BIGINT) AS rows_changed
       FROM orders WHERE o_orderkey % 10 <> 0""",
)
def stream_scores_equal_batch(spark, sf):
    orders = read_table(spark, sf, "orders")
    scorer = _online_scorer(spark, sf)
    batch = S.score_records(_records(orders), "record", scorer)
    stream = S.read_stream(spark, sf, "orders.parquet", plain_times(orders.schema))
    out = S.run_to_table(S.score_records(_records(stream), "record", scorer), "stream-scores")
    streamed = spark.read.parquet(out).select("o_orderkey", F.col("score").alias("s"), F.col("decision").alias("d"))
    same = F.col("score").eqNullSafe(F.col("s")) & F.col("decision").eqNullSafe(F.col("d"))
    return batch.join(streamed, "o_orderkey", "full").agg(
        F.count("score").alias("rows_batch"),
        F.count("s").alias("rows_stream"),
        F.count_if(~same).alias("rows_changed"),
    )


def _odd_records(orders):
    """Records as clients send them: one in five lacks a field, is no JSON, or quotes its numbers."""
    kind = F.col("o_orderkey") % 5
    fields = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", F.unix_timestamp("o_orderdate").alias("sec")]
    quoted = F.struct(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.concat(F.col("o_custkey").cast("string"), F.lit(".0")).alias("o_custkey"),
        F.col("o_totalprice").cast("string").alias("o_totalprice"),
        F.unix_timestamp("o_orderdate").cast("double").alias("sec"),
        F.lit("x").alias("surprise"),
    )
    return orders.select(
        F.when(kind == 1, F.to_json(F.struct("o_orderkey", "o_custkey")))
        .when(kind == 2, F.concat(F.lit("order "), F.col("o_orderkey").cast("string")))
        .when(kind == 3, F.to_json(quoted))
        .otherwise(F.to_json(F.struct(*fields)))
        .alias("record")
    )


@query(
    "parse_or_refuse",
    """SELECT o_orderkey % 5 AS kind, count(*) AS sent, count(*) FILTER (WHERE o_orderkey % 5 NOT IN (1, 2)) AS parsed,
         count(*) FILTER (WHERE o_orderkey % 5 IN (1, 2)) AS refused,
         CASE WHEN o_orderkey % 5 NOT IN (1, 2) THEN CAST(sum(o_custkey) AS BIGINT) END AS customers,
         CASE o_orderkey % 5 WHEN 1 THEN 'o_totalprice,sec' WHEN 2 THEN 'o_custkey,o_orderkey,o_totalprice,sec' END AS missing
       FROM orders GROUP BY 1""",
)
def parse_or_refuse(spark, sf):
    """Parsed and refused records together are all that were sent."""
    records = _odd_records(read_table(spark, sf, "orders"))
    required = ["o_orderkey", "sec", "o_totalprice", "o_custkey"]
    parsed, _ = S.quarantine(json_to_columns(records, "record", _RECORD), required)
    refused = S.refused_records(records, "record", _RECORD, required)
    key = F.regexp_extract("record", r"(\d+)", 1).cast("long")
    both = parsed.select((F.col("o_orderkey") % 5).alias("kind"), "o_custkey", F.lit(None).alias("missing")).unionByName(
        refused.select(
            (key % 5).alias("kind"),
            F.lit(None).cast("long").alias("o_custkey"),
            F.concat_ws(",", F.array_sort("missing_fields")).alias("missing"),
        )
    )
    return both.groupBy("kind").agg(
        F.count("*").alias("sent"),
        F.count("o_custkey").alias("parsed"),
        F.count("missing").alias("refused"),
        F.sum("o_custkey").alias("customers"),
        F.max("missing").alias("missing"),
    )


@query(
    "stream_score_or_refuse",
    """SELECT o_orderkey % 5 AS kind, count(*) AS sent,
         count(*) FILTER (WHERE o_orderkey % 5 NOT IN (1, 2)) AS scored, count(*) FILTER (WHERE o_orderkey % 5 IN (1, 2)) AS refused,
         count(DISTINCT o_orderkey) AS different,
         CASE o_orderkey % 5 WHEN 1 THEN 'o_totalprice,sec' WHEN 2 THEN 'o_custkey,o_orderkey,o_totalprice,sec' END AS missing
       FROM orders GROUP BY 1""",
)
def stream_score_or_refuse(spark, sf):
    """Half of the records arrive, the stream stops, the rest arrives, it goes on."""
    orders = read_table(spark, sf, "orders")
    arriving = scratch_path(spark, "arriving")
    sink = S.ScoreOrRefuse("record", _online_scorer(spark, sf), scratch_path(spark, "score-or-refuse"))
    for half in (0, 1):
        later = orders.filter(F.col("o_orderkey") / 2 % 2 < 1 if half else F.col("o_orderkey") / 2 % 2 >= 1)
        _odd_records(later).write.mode("append").parquet(arriving)
        sink.run(S.read_stream(spark, arriving, "*.parquet", T.StructType([T.StructField("record", T.StringType())]), 4))
    scored, refused = sink.outputs(spark)
    key = F.regexp_extract("record", r"(\d+)", 1).cast("long")
    both = scored.select("o_orderkey", F.col("decision").isNotNull().alias("ok"), F.lit(None).alias("missing")).unionByName(
        refused.select(
            key.alias("o_orderkey"), F.lit(False).alias("ok"), F.concat_ws(",", F.array_sort("missing_fields")).alias("missing")
        )
    )
    return both.groupBy((F.col("o_orderkey") % 5).alias("kind")).agg(
        F.count("*").alias("sent"),
        F.count_if("ok").alias("scored"),
        F.count("missing").alias("refused"),
        F.count_distinct("o_orderkey").alias("different"),
        F.max("missing").alias("missing"),
    )


@query(
    "stream_alert_rate",
    """WITH b AS (SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS s, value FROM events),
       w AS (SELECT strftime(s, '%Y-%m-%d') AS window_start, count(*) AS rows, count(*) FILTER (WHERE value >= 45) AS alerts,
         max(s) + INTERVAL 7 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) AS final FROM b GROUP BY 1)
       SELECT window_start, rows, alerts, round(alerts / CAST(rows AS DOUBLE), 6) AS alert_rate,
         round(alerts / CAST(rows AS DOUBLE) / CAST(0.02 AS DOUBLE), 6) AS alert_rate_ratio, final FROM w""",
)
def stream_alert_rate(spark, sf):
    stream = S.read_stream(spark, sf, "events.parquet", plain_times(read_table(spark, sf, "events").schema))
    volume = S.stream_alert_volume(stream.select("ts", "value"), "ts", "value", 45.0, 0.02)
    return rounded(S.with_open_windows(spark, S.run_to_table(volume, "alerts"), 0.02))
