import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import TINY
from txrisk.operators import ordering as O
from txrisk.operators.encoding import ordered_index
from txrisk.settings import Scale


@pytest.fixture(scope="module")
def ties(spark):
    """A third of the rows share one score."""
    rng = np.random.default_rng(0)
    n = 3000
    score = np.where(rng.random(n) < 0.35, 0.5, np.round(rng.random(n), 2))
    pdf = pd.DataFrame(
        {"id": rng.permutation(n) * 3, "s": score, "y": (rng.random(n) < 0.1).astype(int), "g": rng.integers(0, 3, n)}
    )
    return pdf, spark.createDataFrame(pdf).persist()


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("scale", [Scale(), TINY])
def test_prefix_sums_with_heavy_ties(ties, descending, scale):
    pdf, frame = ties
    got = O.prefix_sums(
        frame, "s", {"k": F.lit(1), "c": F.col("y")}, tie="id", descending=descending, scale=scale
    ).toPandas().sort_values("k")
    want = pdf.sort_values(["s", "id"], ascending=[not descending, True])
    assert got["id"].tolist() == want["id"].tolist()
    assert got["c"].tolist() == want["y"].cumsum().tolist()
    assert got["k"].tolist() == list(range(1, len(pdf) + 1))


def test_no_range_holds_the_hot_value_whole(ties):
    _, frame = ties
    ranged = O._range_frame(frame, [F.col("s"), F.col("id")], "r", frame.count(), TINY)
    sizes = [r["count"] for r in ranged.groupBy("r").count().collect()]
    assert max(sizes) < 0.1 * frame.count()


@pytest.mark.parametrize("kind", ["string", "long", "decimal(20,0)"])
def test_ties_of_any_type(spark, kind):
    """Ids beyond 2^53, and as text; both ways in the id's own order."""
    frame = spark.range(600).select(
        (F.lit(2**60) + F.col("id")).cast(kind).alias("id"), (F.col("id") % 3).cast("double").alias("s")
    )
    small, large = (
        O.prefix_sums(frame, "s", {"k": F.lit(1)}, tie="id", descending=True, scale=scale).collect()
        for scale in (Scale(), TINY)
    )
    assert {(r["id"], r["k"]) for r in small} == {(r["id"], r["k"]) for r in large}


def test_quantiles_of_a_null_group(spark):
    frame = spark.range(3000).select(
        F.when(F.col("id") % 2 == 0, "a").alias("g"), F.sqrt("id").alias("v")
    )
    small, large = (O.exact_quantiles(frame, ["v"], [0.25, 0.5], by="g", scale=s) for s in (Scale(), TINY))
    assert small == large and None in {g for g, _ in large}


def test_all_rows_tied(spark):
    frame = spark.range(500).select("id", F.lit(0.5).alias("s"))
    got = O.prefix_sums(frame, "s", {"k": F.lit(1)}, tie="id", descending=True, scale=TINY)
    assert [(r["id"], r["k"]) for r in got.orderBy("k").collect()] == [(i, i + 1) for i in range(500)]


def test_prefix_sums_per_group(ties):
    pdf, frame = ties
    grouped = frame.groupBy("g", "s").agg(F.count(F.lit(1)).alias("n"))
    for scale in (Scale(), TINY):
        got = O.prefix_sums(grouped, "s", {"c": F.col("n")}, partition_by=["g"], scale=scale).toPandas()
        want = pdf.groupby(["g", "s"]).size().groupby(level=0).cumsum()
        assert {(r.g, r.s): r.c for r in got.itertuples()} == want.to_dict()


def test_prefix_sums_refuse_missing_values(spark):
    frame = spark.createDataFrame([(1, 0.5), (2, None)], "id long, s double")
    with pytest.raises(ValueError):
        O.prefix_sums(frame, "s", {"k": F.lit(1)}, tie="id")


@pytest.mark.parametrize("by", [None, "g"])
def test_exact_quantiles_equal_numpy(ties, spark, by):
    pdf, _ = ties
    pdf = pdf.assign(w=np.random.default_rng(1).normal(size=len(pdf)))
    pdf.loc[::7, "w"] = np.nan
    frame = spark.createDataFrame(pdf)
    probs = [0, 0.1, 0.25, 0.5, 0.8, 0.99, 1]
    for scale in (Scale(), TINY):
        found = O.exact_quantiles(frame, ["s", "w"], probs, by=by, scale=scale, accuracy=200)
        assert len(found) == (2 if by is None else 6)
        for (g, c), got in found.items():
            part = pdf if by is None else pdf[pdf.g == g]
            assert np.allclose(got, np.nanquantile(part[c], probs))


def test_quantiles_when_the_sketch_misses(ties, monkeypatch):
    pdf, frame = ties
    real = O._bracketed

    def blind(*args, everywhere):
        found = real(*args, everywhere=everywhere)
        return found if everywhere else {k: [None] * len(v) for k, v in found.items()}

    monkeypatch.setattr(O, "_bracketed", blind)
    found = O.exact_quantiles(frame, ["s"], [0.25, 0.5], scale=TINY)
    assert np.allclose(found[(None, "s")], np.quantile(pdf.s, [0.25, 0.5]))


def test_quantiles_of_nothing(spark):
    frame = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    assert O.exact_quantiles(frame, ["x"], [0.5]) == {(None, "x"): None}


def test_hash_sample_ignores_partitioning(spark):
    frame = spark.range(2000)
    one = {r["id"] for r in O.hash_sample(frame.repartition(1), "id", 100).collect()}
    many = {r["id"] for r in O.hash_sample(frame.repartition(13), "id", 100).collect()}
    other = {r["id"] for r in O.hash_sample(frame, "id", 100, seed=1).collect()}
    assert len(one) == 100 and one == many and one != other
    assert O.hash_sample(frame, "id", 5000).count() == 2000


def test_average_rank(spark):
    frame = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 2.0), ("d", 1.0)], "f string, v double")
    got = {r["f"]: r["r"] for r in O.average_rank(frame, "v", "r").collect()}
    assert got == {"a": 1, "b": 2, "c": 2, "d": 4}


def test_ordered_index_both_ways(spark):
    words = [f"w{i:04d}" for i in range(300)] + ["(missing)", "é", "Z"]
    frame = spark.createDataFrame([("c", w) for w in words], "column string, label string")
    for scale in (Scale(), TINY):
        got = {r["label"]: r["code"] for r in ordered_index(frame, "column", "label", "code", scale).collect()}
        assert got == {w: i for i, w in enumerate(sorted(words))}
