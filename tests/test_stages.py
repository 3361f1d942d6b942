import json

from pyspark.sql import functions as F

from txrisk.operators import encoding as E
from txrisk.operators import modeling as M
from txrisk.plans import stages
from txrisk.session import scratch_path
from txrisk.settings import DriftRules, PeriodRules


def test_stages_end_to_end(spark, transactions):
    out = scratch_path(spark, "stages")
    side = ["id_31", "id_33", "DeviceInfo"]
    identity = transactions.filter("TransactionID % 4 = 0").select(
        "TransactionID", *[F.col(c).alias(c.replace("_", "-")) for c in side]
    )
    facts = transactions.drop(*side)
    contract = stages.ingest(facts, identity, f"{out}/joined").first()
    assert contract["passed"] and contract["actual_rows"] == 3000
    joined = spark.read.parquet(f"{out}/joined")
    assert dict(joined.dtypes)["isFraud"] == "tinyint" and dict(joined.dtypes)["card1"] == "smallint"
    assert joined.filter("has_identity = 1").count() == 750

    values = [f"V{i}" for i in range(1, 7)]
    stages.describe(joined, out, values, E.EncoderSpec())
    blocks = stages.read_blocks(spark, out)
    assert blocks == (("V1", "V2", "V3"), ("V4", "V5", "V6"))

    spec = E.EncoderSpec(blocks=blocks)
    train, test = joined.filter("TransactionID < 1002400"), joined.filter("TransactionID >= 1002400")
    model = stages.build_features(train, test.drop("isFraud"), out, spec)
    checks = spark.read.option("header", True).csv(f"{out}/reports/feature_checks").collect()
    assert [r["passed"] for r in checks] == ["true"] * 4

    chosen = [c for c in model.feature_names if not c.endswith("_code")][:8]
    winner, threshold = stages.train(
        out, spark, spec, chosen, [M.logistic_candidate("isFraud", 5)], folds=2, rates=[0.02, 0.05]
    )
    assert winner.name == "logistic" and threshold > 0
    scores = spark.read.parquet(f"{out}/test_scores")
    assert scores.count() == 600 and set(scores.columns) == {"TransactionID", "score", "decision"}

    report = lambda name: spark.read.option("header", True).csv(f"{out}/reports/{name}")
    used = [r["feature"] for r in report("final_model").collect()]
    assert set(used) <= set(chosen) and {r["feature"] for r in report("importance").collect()} == set(used)
    board = {r["model"]: r for r in report("model_comparison").collect()}
    assert set(board) == {"logistic", "prior"} and board["prior"]["roc_auc"] == "0.5"
    assert report("cv_summary").first()["folds"] == "2" and report("cv_results").count() == 2
    if M.entity_features(chosen):
        assert report("ablation").first()["tolerance"] == "0.005"
    assert spark.read.parquet(f"{out}/explanations").groupBy("TransactionID").count().filter("count > 6").isEmpty()

    verdict = stages.monitor(
        out, spark, spec, used, None, threshold, 0.02,
        DriftRules(min_rows=100), PeriodRules(min_rows=50, min_positives=1),
    )
    assert verdict in ("RETRAIN", "WATCH", "OK")
    drift = spark.read.option("header", True).csv(f"{out}/reports/feature_drift")
    assert drift.select("feature").distinct().count() == len(used)
    bundle = json.loads("".join(r["value"] for r in spark.read.text(f"{out}/reports/bundle").collect()))
    assert bundle["verdict"][0]["verdict"] == verdict and len(bundle["feature_drift"]) == drift.count()
