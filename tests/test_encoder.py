import math
from dataclasses import asdict

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tests.conftest import TINY
from txrisk.operators import encoding as E
from txrisk.plans import learn
from txrisk.session import scratch_path


def rows_by_id(frame):
    return {r["TransactionID"]: r.asDict() for r in frame.collect()}


def test_features_are_frozen_and_exclude_keys(fitted, transactions):
    names = fitted.feature_names
    assert not {"TransactionID", "TransactionDT", "isFraud", "uid", "flat"} & set(names)
    late = transactions.filter("TransactionID >= 1002400")
    assert fitted.transform(late).columns == ["TransactionID", "TransactionDT", "isFraud", *names]
    shuffled = late.select(*reversed(late.columns))
    assert fitted.transform(shuffled).columns[3:] == names


def test_each_block_keeps_one_column(fitted):
    kept = [c for c in fitted.feature_names if c.startswith("V")]
    assert len(kept) == 2 and kept[0] in ("V1", "V2", "V3") and kept[1] in ("V4", "V5", "V6")
    assert fitted.block_evidence.count() == 2


def test_decisions_cover_every_candidate(spark, fitted, transactions):
    table = {r["column"]: r for r in fitted.column_decisions(spark).collect()}
    assert set(table) == set(transactions.columns) - {"TransactionID", "TransactionDT", "isFraud"}
    assert table["flat"]["decision"] == "drop" and table["card1"]["decision"] == "keep"


def test_reload_changes_nothing(spark, fitted, transactions):
    path = scratch_path(spark, "encoder-test")
    want = rows_by_id(fitted.transform(transactions))
    fitted.save(path)
    again = E.RiskEncoderModel.load(path)
    assert again.feature_names == fitted.feature_names and again.uid == fitted.uid
    assert again.spec == fitted.spec and again.scale == fitted.scale
    assert again.column_decisions(spark).collect() == fitted.column_decisions(spark).collect()
    assert sorted(again.block_evidence.collect()) == sorted(fitted.block_evidence.collect())
    assert rows_by_id(again.transform(transactions)) == want
    with pytest.raises(ValueError):
        again.write().overwrite().save(path)
    fitted.write().overwrite().save(path)
    assert rows_by_id(E.RiskEncoderModel.load(path).transform(transactions)) == want


def test_a_pipeline_saves_and_loads_the_encoder_among_other_stages(spark, fitted, transactions):
    late = transactions.filter("TransactionID >= 1002400")
    wanted = ["card1_freq", "hour", "amount_log"]
    stages = [fitted, VectorAssembler(inputCols=wanted, outputCol="v", handleInvalid="keep")]
    pipeline, path = PipelineModel(stages), scratch_path(spark, "pipeline-test")
    want = sorted(map(str, pipeline.transform(late).select("TransactionID", "v").collect()))
    for _ in range(2):
        pipeline.write().overwrite().save(path)
        again = PipelineModel.load(path)
        assert sorted(map(str, again.transform(late).select("TransactionID", "v").collect())) == want


def test_params_are_copied_saved_and_given_to_fit(spark, transactions):
    encoder = E.RiskEncoder(E.EncoderSpec(passthrough=("flat",)), rescue_min_rows=7)
    path = scratch_path(spark, "estimator-test")
    encoder.write().overwrite().save(path)
    again = E.RiskEncoder.load(path)
    assert again.spec == encoder.spec and again.getOrDefault(again.rescueMinRows) == 7
    strict = encoder.copy({encoder.nearConstantShare: 0.01})
    assert strict.getOrDefault("nearConstantShare") == 0.01
    assert encoder.getOrDefault("nearConstantShare") != 0.01
    train = transactions.filter("TransactionID < 1002400")
    model = Pipeline(stages=[again]).fit(train, {again.nearConstantShare: 0.01}).stages[0]
    assert model.getOrDefault("nearConstantShare") == 0.01 and model.getOrDefault("rescueMinRows") == 7
    shares = {r["column"]: r["dominant_share"] for r in model.column_decisions(spark).collect()}
    reasons = {r["column"]: r["reason"] for r in model.column_decisions(spark).collect()}
    assert all(reasons[c] != "not near-constant" for c, share in shares.items() if share >= 0.01)


def test_lookups_are_written_in_few_files(spark, fitted):
    path = scratch_path(spark, "few-files")
    spread = fitted.lookups.repartition(50)
    columns = spread.select("column").distinct().count()
    E.write_lookups(spread, path)
    again = spark.read.parquet(path)
    assert len(again.inputFiles()) <= columns + int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert again.count() == spread.count()


def test_a_row_alone_equals_the_row_in_a_batch(fitted, transactions):
    whole = rows_by_id(fitted.transform(transactions))
    for key in (1_000_000, 1_000_017, 1_002_999):
        alone = fitted.transform(transactions.filter(F.col("TransactionID") == key)).first().asDict()
        assert alone == whole[key]


def test_large_lookups_give_the_same_features(fitted, transactions):
    small = rows_by_id(fitted.transform(transactions))
    skewed = fitted.copy({fitted.limits: asdict(TINY)})
    assert skewed.scale == TINY and fitted.scale != TINY
    assert rows_by_id(skewed.transform(transactions)) == small


def test_shuffles_do_not_follow_the_number_of_large_lookups(spark, fitted, transactions):
    # the planner must take the tables for as large as the model is told they are
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")

    def exchanges(labels):
        few = fitted.copy()
        few.state = {**fitted.state, "lookup_rows": {c: 10**9 for c in labels}}
        out = few.transform(transactions)
        plan = out._jdf.queryExecution().executedPlan().toString()
        return plan.count("Exchange hashpartitioning"), rows_by_id(out)

    looked_up = fitted._looked_up()
    try:
        none, want = exchanges([])
        one, _ = exchanges(looked_up[:1])
        some, same = exchanges(looked_up[:3])
        every, also = exchanges(looked_up)
    finally:
        spark.conf.set(limit, before)
    assert none == 0 and one == 2 and some == every <= 6 and len(looked_up) > 10
    assert same == also == want


def test_unseen_values(fitted, transactions):
    new = transactions.limit(1).withColumns(
        {"ProductCD": F.lit("never"), "card1": F.lit(999_999).cast("bigint")}
    )
    row = fitted.transform(new).first()
    assert row["ProductCD_code"] == -1 and row["card1_freq"] == 0.0
    assert row["TransactionAmt_mean_by_card1"] is None and row["TransactionAmt_ratio_to_card1_mean"] is None


def test_absent_columns_become_null(fitted, transactions):
    row = fitted.transform(transactions.drop("D15", "id_33", "M1")).first()
    assert row["D15"] is None and row["screen_width"] is None and row["match_missing_count"] >= 1


def test_fit_needs_labels(transactions):
    with pytest.raises(ValueError):
        E.RiskEncoder().fit(transactions.drop("isFraud"))


def test_frequencies_are_train_shares(fitted, transactions):
    train = transactions.filter("TransactionID < 1002400")
    n = train.filter("card1 = 1005").count()
    row = fitted.transform(transactions.filter("card1 = 1005")).first()
    assert row["card1_freq"] == pytest.approx(n / 2400)
    mean, std = train.filter("card1 = 1005").agg(
        F.avg("TransactionAmt"), F.stddev_samp("TransactionAmt")
    ).first()
    assert row["TransactionAmt_mean_by_card1"] == pytest.approx(mean)
    assert row["TransactionAmt_std_by_card1"] == pytest.approx(std)


def test_split_is_ordered_and_sized(transactions):
    split, boundary = E.time_split(transactions, "TransactionDT")
    ends = {
        r["split"]: r
        for r in split.groupBy("split")
        .agg(F.min("TransactionDT").alias("lo"), F.max("TransactionDT").alias("hi"), F.count("*").alias("n"))
        .collect()
    }
    assert ends["train"]["hi"] <= boundary < ends["valid"]["lo"]
    assert math.isclose(ends["valid"]["n"] / 3000, 0.2, abs_tol=0.02)


def test_a_category_planted_after_the_cut_stays_unknown(transactions):
    planted = transactions.withColumn(
        "ProductCD", F.when(F.col("TransactionID") >= 1_002_400, "later").otherwise(F.col("ProductCD"))
    )
    model = E.RiskEncoder().fit(planted.filter("TransactionID < 1002400"))
    codes = model.transform(planted.filter("TransactionID >= 1002400")).select("ProductCD_code").distinct()
    assert [r[0] for r in codes.collect()] == [-1]


def test_no_feature_tracks_the_clock(fitted, transactions):
    encoded = fitted.transform(transactions)
    checks = E.clock_leak_check(encoded, fitted.feature_names, "TransactionDT")
    assert checks.filter("tracks_clock").count() == 0
    clock = encoded.withColumn("clock", F.col("TransactionDT") * 2.0)
    assert E.clock_leak_check(clock, ["clock"], "TransactionDT").first()["tracks_clock"]


def test_manifest_and_checks(fitted, transactions):
    train = fitted.transform(transactions.filter("TransactionID < 1002400"))
    test = fitted.transform(transactions.filter("TransactionID >= 1002400"))
    manifest = {r["feature"]: r for r in E.feature_manifest(fitted, train, test).collect()}
    assert set(manifest) == set(fitted.feature_names)
    assert manifest["uid_freq"]["kind"] == "frequency" and manifest["hour"]["kind"] == "derived_time"
    checks = E.feature_checks(train, test, fitted.feature_names, "isFraud").collect()
    assert all(r["passed"] for r in checks) and len(checks) == 4
    broken = train.withColumns({"hour": F.lit(None).cast("long"), "D1": F.lit(float("inf"))})
    bad = E.feature_checks(broken, test.drop("card1_freq"), [*fitted.feature_names, "isFraud"], "isFraud")
    found = {r["check"]: (r["passed"], r["columns"]) for r in bad.collect()}
    assert found["all_null"] == (False, "hour") and found["infinite"] == (False, "D1")
    assert not found["label_in_features"][0] and "card1_freq" in found["columns_differ"][1]
    assert 0 < E.unseen_share(test, ["uid_freq"]).first()[0] <= 1


def test_encoder_queries_work_on_what_they_need(spark, monkeypatch):
    """One join a query, no side encoded that is not read, nothing written that is read once; fits read written rows."""
    written, encoded, joined = [], [], []
    write, transform, join = learn.materialise, E.RiskEncoderModel.transform, learn.enriched
    monkeypatch.setattr(learn, "materialise", lambda frame, name: written.append(name) or write(frame, name))
    monkeypatch.setattr(E.RiskEncoderModel, "transform", lambda *given: encoded.append(1) or transform(*given))
    monkeypatch.setattr(learn, "enriched", lambda *given: joined.append(1) or join(*given))
    sf = "/root/testdata/sf0.001"
    for query, sides in ((learn.unseen_share, 1), (learn.feature_manifest, 2), (learn.encoder_reload_equal, 2)):
        for seen in (written, encoded, joined):
            seen.clear()
        query(spark, sf)
        assert (written, len(encoded), len(joined)) == (["joined"], sides, 1)
    written.clear()
    learn._online_scorer(spark, sf)
    assert written == ["online-features"]
