import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from txrisk.operators import boosting as B
from txrisk.operators import modeling as M
from txrisk.operators.imputing import ExactImputer
from txrisk.operators.ranking import Scored, ranking_metrics
from txrisk.session import scratch_path

NAMES = Scored("id", "score", "y", "amount")
FEATURES = ["a", "b", "gappy"]
QUICK = B.Recipe("quick", depth=3, step=0.3, rows=0.8, columns=0.8)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    n = 1600
    a, b, g = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
    # Missing rows are the riskiest, the lowest known values the safest.
    gone = rng.random(n) < 0.2
    y = (a + 0.5 * b + np.where(gone, 1.5, 0.8 * g) + rng.normal(0, 0.7, n) > 1.4).astype(int)
    data = [(i, float(a[i]), float(b[i]), None if gone[i] else float(g[i]), int(y[i]), 10.0) for i in range(n)]
    frame = spark.createDataFrame(data, "id long, a double, b double, gappy double, y int, amount double").persist()
    return frame.filter("id < 1200"), frame.filter("id >= 1200")


@pytest.fixture(scope="module")
def model(rows):
    return B.early_stopped(QUICK, *rows, FEATURES, "y", max_rounds=24, patience=4, first_rounds=3)


def test_stopping_point():
    assert B.stopping_point([0.1, 0.3, 0.2, 0.3, 0.25], 3) == (2, 5, True)
    assert B.stopping_point([0.1, 0.3, 0.2, 0.3, 0.25, 0.9], 3) == (2, 5, True)
    assert B.stopping_point([0.1, 0.2, 0.3], 2) == (3, 3, False)
    assert B.stopping_point([0.5], 1) == (1, 1, False)


def test_scores_of_all_rounds_are_the_models_own(rows, model):
    """The running sum over leaves ends at MLlib's own probability."""
    own = B.assembled(rows[1], FEATURES, model.indicators).withColumn("y", F.col("y").cast("double"))
    rounds = len(model.trees.treeWeights)
    last = B.round_scores(model.trees, own, "y").filter(F.col("round") == rounds)
    mine = sorted(r["score"] for r in last.collect())
    theirs = sorted(float(r[0][1]) for r in model.trees.transform(own).select("__tp").collect())
    assert np.allclose(mine, theirs, atol=1e-12)


def test_best_round_and_its_scores(rows, model):
    precisions = [r["pr_auc"] for r in model.log]
    assert model.best_round == 1 + int(np.argmax(precisions)) <= model.rounds_tried <= 24
    assert model.runs > 1  # three rounds were not enough
    candidate = M.early_stopped_candidate(QUICK, 24, 4)
    scored = M.score(candidate, model, rows[1], FEATURES, ["id", "y"])
    again = ranking_metrics(scored, NAMES).first()["pr_auc"]
    assert abs(again - max(precisions)) < 1e-9
    log = B.log_frame(rows[1], model)
    assert log.filter("kept").count() == model.best_round and log.count() == model.rounds_tried


def test_longer_runs_begin_alike(rows, model):
    """What doubling rests on: the first trees of a longer run are those of a shorter one."""
    ready = B.assembled(rows[0], FEATURES, model.indicators).select(F.col("y").cast("double").alias("label"), "__x")
    short, long = (B.grow(ready, "label", QUICK, n) for n in (2, 4))
    assert B.leaf_values(short) == B.leaf_values(long)[:2]


def test_indicators(rows, model):
    assert model.indicators == ("gappy",)
    own = B.assembled(rows[0], FEATURES, model.indicators).select("gappy", "__x").collect()
    assert all(r["__x"][3] == (r["gappy"] is None) for r in own)
    assert all(r["__x"][2] == B.SENTINEL for r in own if r["gappy"] is None)
    gains = {r["feature"]: r["weight"] for r in M.importance(model, rows[1], FEATURES).collect()}
    assert set(gains) == set(FEATURES) and abs(sum(gains.values()) - 1) < 1e-6 and gains["gappy"] > 0.1


def test_leaderboard_and_refit(spark, rows):
    fitted = {}
    table = M.compare_candidates(
        [M.early_stopped_candidate(QUICK, 6, 3), M.logistic_candidate("y", 10)], *rows, FEATURES, NAMES, prior=True, fitted=fitted
    ).collect()
    by = {r["model"]: r for r in table}
    assert list(by)[-1] == M.PRIOR and set(by) == {"quick", "logistic", M.PRIOR}
    assert abs(by[M.PRIOR]["pr_auc"] - by[M.PRIOR]["pr_auc_baseline"]) < 1e-12 and by[M.PRIOR]["roc_auc"] == 0.5
    assert by["quick"]["best_round"] == fitted["quick"].best_round and by["logistic"]["best_round"] is None
    assert all(r["fit_seconds"] >= 0 for r in table)
    recipe = M.early_stopped_candidate(QUICK, 6, 3)
    everything = rows[0].unionByName(rows[1])
    final, model = M.refit_all(recipe.with_rounds, 3, 1200, everything, FEATURES, "y")
    assert len(model.trees.treeWeights) == model.best_round == 4 and final.patience == 0
    assert M.score(final, model, everything, FEATURES, ["id"]).count() == 1600


def test_three_recipes():
    assert len({r.name for r in B.RECIPES}) == 3 and {r.step for r in B.RECIPES} == {0.05}


def test_rows_without_features_or_gaps(rows):
    assert B.indicated(rows[0], []) == [] and B.indicated(rows[0], ["a", "b"]) == []


def test_exact_imputer(spark):
    data = [(1.0, None), (2.0, None), (None, None), (10.0, None), (float("nan"), None)]
    frame = spark.createDataFrame(data, "x double, none double")
    fitted = Pipeline(stages=[ExactImputer(inputCols=["x", "none"], outputCols=["fx", "fn"])]).fit(frame)
    path = scratch_path(spark, "imputer")
    fitted.write().overwrite().save(path)
    for model in (fitted, PipelineModel.load(path)):
        assert model.stages[0].surrogates() == {"x": 2.0, "none": 0.0}
        assert sorted(r["fx"] for r in model.transform(frame).collect()) == [1.0, 2.0, 2.0, 2.0, 10.0]
        assert {r["fn"] for r in model.transform(frame).collect()} == {0.0}


def test_gradient_is_flat(rows):
    train, _ = rows
    candidate = M.logistic_candidate("y", 60)
    model = M.fit(candidate, train, FEATURES, "y")
    assert all(abs(g) < 1e-4 for g in M.logistic_gradient(candidate, model, train, FEATURES, "y").values())
    rough = M.fit(M.logistic_candidate("y", 1), train, FEATURES, "y")
    assert max(abs(g) for g in M.logistic_gradient(candidate, rough, train, FEATURES, "y").values()) > 1e-3
