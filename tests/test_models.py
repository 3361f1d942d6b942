import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from txrisk.operators import imputing
from txrisk.operators import modeling as M
from txrisk.operators.ranking import Scored, ranking_metrics
from txrisk.session import scratch_path
from txrisk.streaming import scoring as S

NAMES = Scored("id", "score", "y", "amount")
FEATURES = ["a", "b", "noise"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    n = 2000
    a, b, z = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
    y = (a + 0.5 * b + rng.normal(0, 0.5, n) > 1.2).astype(int)
    data = [
        (i, i * 10, float(a[i]) if i % 11 else None, float(b[i]), float(z[i]), int(y[i]), 10.0) for i in range(n)
    ]
    frame = spark.createDataFrame(data, "id long, t long, a double, b double, noise double, y int, amount double").persist()
    return frame.filter("id < 1500"), frame.filter("id >= 1500"), frame


def test_candidates_beat_the_prior(rows):
    train, valid, _ = rows
    table = M.compare_candidates(
        [M.logistic_candidate("y", 20), M.boosted_candidate("y", rounds=3, depth=3)], train, valid, FEATURES, NAMES
    ).collect()
    assert {r["model"] for r in table} == {"logistic", "boosted"}
    assert all(r["pr_auc_lift"] > 2 and r["roc_auc"] > 0.8 for r in table)
    assert table[0]["pr_auc"] >= table[1]["pr_auc"]
    flat = M.prior_scores(train, valid, "y")
    assert flat.select("score").distinct().count() == 1


def test_folds_expand_and_never_look_ahead(rows):
    _, _, frame = rows
    summary = M.fold_summary(M.expanding_folds(frame, "t"), "t").orderBy("fold").collect()
    assert [(r["train_rows"], r["valid_rows"]) for r in summary] == [(400, 400), (800, 400), (1200, 400), (1600, 400)]
    ends = M.expanding_folds(frame, "t").groupBy("fold", "role").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    by = {(r["fold"], r["role"]): r for r in ends.collect()}
    assert all(by[f, "train"]["hi"] < by[f, "valid"]["lo"] for f in range(1, 5))


def test_cross_validation_and_ablation(rows):
    train, valid, frame = rows
    candidate = M.logistic_candidate("y", 10)
    cv = M.cross_validate(candidate, frame, FEATURES, "t", NAMES, folds=2)
    stable = M.fold_stability(cv).first()
    assert stable["folds"] == 2 and stable["pr_auc_mean"] > 0.5 and stable["pr_auc_std"] < 0.2
    keep = M.ablation(candidate, train, valid, FEATURES, ["a"], NAMES).first()
    drop = M.ablation(candidate, train, valid, FEATURES, ["noise"], NAMES).first()
    assert not keep["drop_family"] and drop["drop_family"]


def test_ablation_finds_medians_once_and_scores_the_same(rows, monkeypatch):
    train, valid, _ = rows
    candidate = M.logistic_candidate("y", 10)
    found = []
    learn = imputing.exact_quantiles
    monkeypatch.setattr(imputing, "exact_quantiles", lambda *a, **b: found.append(a) or learn(*a, **b))
    row = M.ablation(candidate, train, valid, FEATURES, ["b"], NAMES).first()
    assert len(found) == 1
    alone = M.fit(candidate, train, ["a", "noise"], "y")
    scored = M.score(candidate, alone, valid, ["a", "noise"], ["y"])
    assert ranking_metrics(scored, NAMES).first()["pr_auc"] == pytest.approx(row["without_pr_auc"], abs=1e-12)


def test_refit_scales_rounds(rows):
    train, _, frame = rows
    seen = []

    def recipe(rounds):
        seen.append(rounds)
        return M.boosted_candidate("y", rounds=rounds, depth=2)

    M.refit_all(recipe, 3, train.count(), frame, FEATURES, "y")
    assert seen == [4]


def test_contributions_add_up_to_the_score(rows):
    train, valid, _ = rows
    candidate = M.logistic_candidate("y", 20)
    model = M.fit(candidate, train, FEATURES, "y")
    parts = M.linear_contributions(model, valid, FEATURES, ["id"])
    total = parts.select("id", sum((F.col(c) for c in FEATURES), F.lit(model.stages[-1].intercept)).alias("m"))
    both = M.score(candidate, model, valid, FEATURES, ["id"]).join(total, "id").collect()
    assert np.allclose([r["score"] for r in both], [1 / (1 + np.exp(-r["m"])) for r in both])
    summary = M.importance_summary(parts, FEATURES).collect()
    assert [r["feature"] for r in summary] == ["a", "b", "noise"]
    explained = M.row_explanations(parts, "id", FEATURES, 2).collect()
    assert len(explained) == 2 * valid.count()


def test_features_by_marker():
    names = ["card1_freq", "uid_freq", "Amt_mean_by_uid", "Amt_ratio_to_uid_mean", "hour"]
    assert M.entity_features(names) == names[1:4]


def test_stream_equals_batch_and_quarantines(spark, transactions, fitted):
    frame = transactions.filter("TransactionID >= 1002400")
    train = fitted.transform(transactions.filter("TransactionID < 1002400"))
    features = fitted.feature_names
    candidate = M.logistic_candidate("isFraud", 5)
    model = M.fit(candidate, train, features, "isFraud")
    schema = transactions.drop("isFraud").schema
    scorer = S.Scorer(schema, S.REQUIRED_FIELDS, fitted, candidate, model, features, 0.06)
    records = frame.select(
        F.to_json(F.struct(*[c for c in schema.names if c != "ProductCD"],
                           F.when(F.col("TransactionID") % 2 == 0, F.col("ProductCD")).alias("ProductCD"))).alias("record")
    )
    folder = scratch_path(spark, "records")
    records.repartition(3).write.parquet(folder)
    batch = {r["TransactionID"]: (r["score"], r["decision"]) for r in S.score_records(records, "record", scorer).collect()}
    stream = S.read_stream(spark, folder, "*.parquet", records.schema)
    out = spark.read.parquet(S.run_to_table(S.score_records(stream, "record", scorer), "scores"))
    assert {r["TransactionID"]: (r["score"], r["decision"]) for r in out.collect()} == batch
    assert len(batch) == 300 and all(0 <= s <= 1 for s, _ in batch.values())
    assert {d for _, d in batch.values()} == {"review", "pass"}


def test_refused_rows_name_what_they_lack(spark):
    frame = spark.createDataFrame([(1, None, None), (2, 1.0, "W")], "TransactionID int, TransactionAmt double, ProductCD string")
    valid, refused = S.quarantine(frame, frame.columns)
    assert [r["TransactionID"] for r in valid.collect()] == [2]
    assert refused.first()["missing_fields"] == ["TransactionAmt", "ProductCD"]


def test_alert_volume_drops_late_rows(spark):
    folder = scratch_path(spark, "late")
    day = "2024-01-{:02d} 00:00:00"
    # Spark filters late rows by the watermark of the batch before, so the late
    # row comes two batches after the one that moved it.
    batches = [[(day.format(d), 1.0) for d in (4, 5, 12, 20)], [(day.format(21), 1.0)], [(day.format(6), 1.0)],
               [("2024-02-20 00:00:00", 0.0)]]
    for rows in batches:
        part = spark.createDataFrame(rows, "ts string, score double")
        part.select(F.col("ts").cast("timestamp").alias("ts"), "score").coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    stream = spark.readStream.schema("ts timestamp, score double").option("maxFilesPerTrigger", 1).parquet(folder)
    out = spark.read.parquet(S.run_to_table(S.stream_alert_volume(stream, "ts", "score", 0.5, 0.1), "volume"))
    got = {r["window_start"]: r["rows"] for r in out.collect()}
    assert got["2024-01-11"] == 1 and got["2024-01-18"] == 2 and got["2024-01-04"] == 2


def test_folds_read_what_is_behind_their_rows_once(spark, rows):
    _, _, frame = rows
    seen = spark.sparkContext.accumulator(0)

    def counted(v):
        seen.add(1)
        return v

    work = frame.withColumn("b", F.udf(counted, "double")("b"))
    M.cross_validate(M.logistic_candidate("y", 3), work, FEATURES, "t", NAMES, folds=2).collect()
    assert seen.value == frame.count()


def test_model_rows_are_written_once(spark):
    from txrisk.plans.learn import _model_split
    from txrisk.session import run_root

    for half in _model_split(spark, "/root/testdata/sf0.001"):
        assert half.inputFiles() and all(run_root(spark) in f for f in half.inputFiles())
