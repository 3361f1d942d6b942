import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import TINY
from txrisk.operators import drift as D
from txrisk.settings import DRIFT, DriftRules, Scale


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(42)
    n = 6000
    ref = pd.DataFrame({"a": rng.normal(size=n), "u": rng.random(n), "flag": rng.integers(0, 2, n).astype(float)})
    same = ref.assign(p="1-same")
    noise = ref.assign(a=rng.normal(0.02, 1, n), p="2-noise")
    moved = ref.assign(
        a=rng.normal(2, 1, n), u=np.where(rng.random(n) < 0.82, 0.0, rng.random(n)), p="3-moved"
    )
    few = ref.head(20).assign(p="4-few")
    blank = ref.assign(p="5-blank")
    blank.loc[::2, "a"] = np.nan
    cur = pd.concat([same, noise, moved, few, blank])
    return ref, cur, spark.createDataFrame(ref).persist(), spark.createDataFrame(cur).persist()


def psi_by_hand(ref, cur, bins=10):
    edges = np.unique(np.quantile(ref, np.linspace(0, 1, bins + 1)))
    inner = edges[1:-1]
    shares = [
        np.maximum(np.bincount(np.searchsorted(inner, v, "right"), minlength=len(inner) + 1) / len(v), 1e-6)
        for v in (ref, cur)
    ]
    return float(np.sum((shares[1] - shares[0]) * np.log(shares[1] / shares[0])))


@pytest.fixture(scope="module", params=[Scale(), TINY], ids=["small", "distributed"])
def table(request, sides):
    _, _, r, c = sides
    rows = D.compare_features(r, c, ["a", "u", "flag"], "p", scale=request.param).collect()
    return {(x["period"], x["feature"]): x for x in rows}


def test_expected_bands(table):
    assert table["1-same", "a"]["psi"] < 0.01 and table["1-same", "a"]["ks"] == 0
    assert table["2-noise", "a"]["psi"] < 0.10
    assert table["3-moved", "a"]["psi"] > 0.25 and table["3-moved", "a"]["ks"] > 0.5
    collapse = table["3-moved", "u"]
    assert collapse["psi"] > 0.25 and collapse["missing_current"] == 0


def test_too_few_rows_or_edges_give_null(table):
    assert table["4-few", "a"]["psi"] is None and table["4-few", "a"]["ks"] is None
    assert table["4-few", "a"]["band"] == "unknown"
    assert table["1-same", "flag"]["psi"] is None


def test_missing_shares(table):
    row = table["5-blank", "a"]
    assert row["missing_current"] == pytest.approx(0.5) and row["missing_reference"] == 0
    assert row["missing_change"] == pytest.approx(0.5)
    assert row["rows_current"] == 3000 and row["low_confidence"]


def test_psi_and_ks_by_hand(sides, table):
    ref, cur, _, _ = sides
    for (period, feature), row in table.items():
        now = cur.loc[cur.p == period, feature].dropna().to_numpy()
        if row["psi"] is not None:
            assert row["psi"] == pytest.approx(psi_by_hand(ref[feature].to_numpy(), now))
        if row["ks"] is not None:
            x = np.unique(np.concatenate([ref[feature], now]))
            cdf = lambda v: np.searchsorted(np.sort(v), x, "right") / len(v)
            assert row["ks"] == pytest.approx(np.abs(cdf(ref[feature]) - cdf(now)).max())


@pytest.mark.parametrize("ranges", [2, 7, 200])
def test_ks_looks_only_where_a_greater_gap_may_be(spark, ranges):
    """Steps, spikes, shifted tails and a null period, against every value; few ranges leave much open."""
    rng = np.random.default_rng(ranges)
    n = 2500
    ref = pd.DataFrame({"a": rng.normal(size=n), "s": rng.choice([0.0, 1.0, 5.0], n), "t": rng.exponential(size=n)})
    far = ref.assign(a=ref.a + 9, s=1.0, t=rng.exponential(2, n), p="far")
    near = pd.DataFrame({"a": rng.normal(0.05, 1, n), "s": ref.s, "t": np.round(rng.exponential(size=n), 1), "p": "near"})
    odd = ref.assign(t=np.where(rng.random(n) < 0.5, np.nan, ref.t), p=None)
    cur = pd.concat([far, near, odd])
    scale = Scale(ks_ranges=ranges)
    got = D.ks_by_period(spark.createDataFrame(ref), spark.createDataFrame(cur), ["a", "s", "t"], "p", scale=scale).collect()
    assert len(got) == 9
    for row in got:
        now = cur.loc[cur.p.isna() if row["period"] is None else cur.p == row["period"], row["feature"]].dropna().to_numpy()
        x = np.unique(np.concatenate([ref[row["feature"]], now]))
        cdf = lambda v: np.searchsorted(np.sort(v), x, "right") / len(v)
        want = np.abs(cdf(ref[row["feature"]].to_numpy()) - cdf(now)).max()
        assert row["ks"] == pytest.approx(want, abs=1e-12)


def test_ks_leaves_most_values_uncounted(spark):
    """A clear shift leaves open only the ranges around the greatest gap."""
    ref = spark.range(20_000).select((F.col("id") / 7).alias("v"))
    both = ref.select(F.lit(-1).alias("side"), "v").unionByName(ref.select(F.lit(0).alias("side"), (F.col("v") * 1.5).alias("v")))
    splits = D.range_splits(both, ["v"], 200)
    ranged = D.many_value_ranges(both, splits, {"v": "range"}).withColumn("feature", F.lit("v"))
    counted = ranged.groupBy("feature", "range").agg(
        F.count_if(F.col("side") == -1).alias("n_ref"), F.count_if(F.col("side") == 0).alias("n_p0"), F.min("v").alias("lo"), F.max("v").alias("hi")
    )
    found = D._bounds(counted, ["ref", "p0"], DRIFT)
    assert found.count() >= 190 and found.filter("open").count() <= 6


def test_null_period_keeps_all_measures(spark, sides):
    """A period without a name has its own PSI, KS, quantiles and verdict row."""
    _, _, r, c = sides
    c = c.filter("p in ('1-same', '3-moved')").withColumn("p", F.when(F.col("p") == "1-same", F.col("p")))
    drift = D.compare_features(r, c, ["a", "u"], "p")
    rows = {(x["period"], x["feature"]): x for x in drift.collect()}
    assert len(rows) == 4 and rows[None, "a"]["ks"] > 0.5 and rows[None, "a"]["psi"] > 0.25
    weights = spark.createDataFrame([("a", 1.0), ("u", 1.0)], "feature string, weight double")
    moved = D.score_drift(c, "p", drift, weights, 0.9, 0.1, "u").collect()
    assert {x["period"] for x in moved} == {None, "1-same"}
    assert all(x["weighted_psi"] is not None and x["score_p50"] is not None for x in moved)


def test_missing_rate(spark):
    frame = spark.createDataFrame([(1.0,), (None,), (3.0,), (float("inf"),)], "x double")
    assert D.missing_rate(frame, ["x"]).first()["missing_rate"] == 0.5


def test_weighted_drift_divides_by_all_weights(spark):
    drift = spark.createDataFrame([("p", "a", 0.4), ("p", "b", None)], "period string, feature string, psi double")
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "feature string, weight double")
    assert D.weighted_drift(drift, weights).first()["weighted_psi"] == pytest.approx(0.1)
    none = drift.withColumn("psi", F.lit(None).cast("double"))
    assert D.weighted_drift(none, weights).first()["weighted_psi"] is None


@pytest.mark.parametrize(
    "psi, ratio, top, verdict",
    [
        (0.2, 1.0, 0, "RETRAIN"),
        (0.01, 1.0, 3, "RETRAIN"),
        (0.06, 1.0, 0, "WATCH"),
        (0.01, 1.6, 0, "WATCH"),
        (0.01, 1.2, 2, "OK"),
    ],
)
def test_verdicts(spark, psi, ratio, top, verdict):
    rows = [("2018-01", psi, 9.0, 9), ("2018-02", 0.0, ratio, top)]
    table = spark.createDataFrame(
        rows, "period string, weighted_psi double, alert_rate_ratio double, top_features_significant long"
    )
    assert D.drift_verdict(table).first()["verdict"] == verdict


def test_score_drift_skips_short_periods(spark, sides):
    _, _, r, c = sides
    rules = DriftRules(min_rows=1000)
    drift = D.psi_by_period(r, c, ["a", "u"], "p", rules)
    weights = spark.createDataFrame([("a", 1.0), ("u", 1.0)], "feature string, weight double")
    rows = D.score_drift(c, "p", drift, weights, 0.9, 0.1, "u", rules).collect()
    assert sorted(x["period"] for x in rows) == ["1-same", "2-noise", "3-moved", "5-blank"]
    moved = next(x for x in rows if x["period"] == "3-moved")
    assert moved["features_significant"] == 2 and moved["top_features_significant"] == 2
    assert DRIFT.top_features == 20


@pytest.mark.parametrize(("rows", "tasks"), [(1000, 60), (50, 200)])
def test_ks_sorts_in_tasks_that_follow_the_rows(sides, rows, tasks):
    _, _, r, c = sides
    scale = Scale(single_task_rows=rows, ks_ranges=7)
    plan = D.ks_by_period(r, c, ["a", "u"], "p", scale=scale)._jdf.queryExecution().toString()
    dealt = [int(n) for n in re.findall(r"hashpartitioning\(feature#\d+, range#\d+, (\d+)\), REPARTITION_BY_NUM", plan)]
    assert dealt
    assert all(10 < n <= tasks for n in dealt)
