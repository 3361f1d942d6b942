import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import TINY
from txrisk.operators import ranking as R
from txrisk.settings import Scale

SCHEMA = "id long, score double, label int, amount double"


@pytest.fixture(scope="module")
def four(spark):
    rows = [(0, 0.9, 1, 100.0), (1, 0.8, 0, 50.0), (2, 0.7, 1, 200.0), (3, 0.1, 0, 10.0)]
    return spark.createDataFrame(rows, SCHEMA)


def frame_of(spark, labels, scores):
    rows = [(i, float(s), int(y), 1.0) for i, (y, s) in enumerate(zip(labels, scores))]
    return spark.createDataFrame(rows, SCHEMA)


def test_perfect_and_constant_rankings(spark):
    best = R.ranking_metrics(frame_of(spark, [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9])).first()
    assert best["pr_auc"] == 1.0 and best["roc_auc"] == 1.0
    flat = R.ranking_metrics(frame_of(spark, [0, 0, 0, 1], [0.5] * 4)).first()
    assert flat["pr_auc"] == 0.25 and flat["roc_auc"] == 0.5 and flat["pr_auc_lift"] == 1.0


def test_one_class_has_no_area(spark):
    none = R.ranking_metrics(frame_of(spark, [0, 0], [0.1, 0.2])).first()
    assert none["roc_auc"] is None and none["pr_auc"] is None


@pytest.mark.parametrize("scale", [Scale(), TINY, Scale(single_task_rows=1)])
def test_cost_curve_by_hand(four, scale):
    curve = {r["n_flagged"]: r for r in R.cost_curve(four, scale=scale).collect()}
    assert sorted(curve) == [0, 1, 2, 3, 4]
    assert curve[0]["total_cost"] == pytest.approx(350.0) and curve[0]["savings"] == 0
    assert curve[0]["threshold"] == float("inf")
    assert curve[1]["total_cost"] == pytest.approx(241.5)
    assert curve[1]["savings"] == pytest.approx(108.5)
    assert curve[1]["positives_caught"] == 1 and curve[1]["precision"] == 1
    assert curve[4]["positives_missed"] == 0 and curve[4]["recall"] == 1


def test_missing_amount_counts_as_zero(spark):
    frame = spark.createDataFrame([(0, 0.9, 1, None), (1, 0.1, 0, 5.0)], SCHEMA)
    assert R.cost_curve(frame).filter("n_flagged = 0").first()["total_cost"] == 25.0


def test_review_rate(four):
    row = R.review_rate_metrics(four, [0.5]).first()
    assert (row["n_reviewed"], row["positives_caught"], row["recall"], row["precision"]) == (2, 1, 0.5, 0.5)


def test_review_rate_rounds_half_to_even_and_keeps_one(spark):
    frame = frame_of(spark, [1, 0, 0, 0, 0], [0.9, 0.8, 0.7, 0.6, 0.5])
    got = {r["review_rate"]: r["n_reviewed"] for r in R.review_rate_metrics(frame, [0.5, 0.3, 0.01]).collect()}
    assert got == {0.5: 2, 0.3: 2, 0.01: 1}


@pytest.fixture(scope="module")
def many(spark):
    rng = np.random.default_rng(3)
    y = (rng.random(2000) < 0.05).astype(int)
    s = np.round(np.clip(0.4 * y + 0.6 * rng.random(2000), 0, 1), 2)
    a = np.round(rng.gamma(2, 60, 2000), 2)
    rows = [(i, float(s[i]), int(y[i]), float(a[i])) for i in range(2000)]
    return (y, s, a), spark.createDataFrame(rows, SCHEMA).persist()


def test_capacity_binds_and_never_helps(many):
    curve = R.cost_curve(many[1])
    free, bound = R.best_operating_point(curve).first(), R.best_operating_point(curve, 0.02).first()
    assert bound["review_rate"] <= 0.02 and free["savings"] >= bound["savings"]


def test_results_do_not_depend_on_scale_or_partitions(spark, many):
    _, frame = many
    want = R.evaluate_all(frame).first().asDict()
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    for partitions, scale in (("1", TINY), ("7", TINY), ("7", Scale())):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = R.evaluate_all(frame.repartition(5), scale=scale).first().asDict()
        assert got == pytest.approx(want, rel=1e-12)
    spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert "recall_at_0p500pct" in want and "precision_at_5p000pct" in want


def test_areas_equal_pair_counting(many):
    (y, s, _), frame = many
    pos, neg = s[y == 1], s[y == 0]
    wins = (pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2
    for scale in (Scale(), TINY):
        got = R.ranking_metrics(frame, scale=scale).first()
        assert got["roc_auc"] == pytest.approx(wins / (len(pos) * len(neg)))
        cuts = [(y[s >= t].sum(), (s >= t).sum()) for t in sorted(set(s), reverse=True)]
        ap = sum((c - p) / len(pos) * c / n for (c, n), p in zip(cuts, [0] + [c for c, _ in cuts]))
        assert got["pr_auc"] == pytest.approx(ap)


def test_thin_curve_starts_at_zero(many):
    thin = [r["n_flagged"] for r in R.curve_thin(R.cost_curve(many[1]), 100).orderBy("n_flagged").collect()]
    assert thin == list(range(0, 2001, 20))


def test_pr_curve_ends_at_zero_recall(four):
    last = R.pr_curve(four).filter("threshold IS NULL").first()
    assert (last["precision"], last["recall"]) == (1.0, 0.0)


def test_periods_below_the_floor_are_left_out(many):
    _, frame = many
    weeks = frame.withColumn("week", F.when(F.col("id") < 1900, "a").otherwise("b"))
    rows = R.period_performance(weeks, "week").collect()
    assert [r["period"] for r in rows] == ["a"] and not rows[0]["is_full_period"]


def test_shares_round_as_the_sql_twins_do(spark):
    import duckdb

    from txrisk.plans.registry import rounded

    rows = 6_000_000
    shares = spark.range(1, 4001).select("id", (F.col("id") / F.lit(rows)).alias("share"))
    got = {r["id"]: r["share"] for r in rounded(shares).collect()}
    sql = f"SELECT i, round(i / CAST({rows} AS DOUBLE), 6) FROM range(1, 4001) t(i)"
    assert got == dict(duckdb.sql(sql).fetchall())
    odd = spark.sql("SELECT double('Infinity') AS a, -2.5D AS b, double(null) AS c, 1.7e308D AS d")
    assert tuple(rounded(odd, at={"b": 0}).first()) == (float("inf"), -3.0, None, 1.7e308)
    third = spark.sql("SELECT 1D / 3 AS a, 1D / 3 AS b")
    assert tuple(rounded(third, at={"a": None}).first()) == (1 / 3, 0.333333)
