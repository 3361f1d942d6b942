from dataclasses import replace

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.conftest import TINY
from txrisk.operators import joins as J
from txrisk.operators import profile as P
from txrisk.operators import selection as C
from txrisk.session import materialise, scratch_path, scratch_root
from txrisk.settings import SCALE
from txrisk.sources import tables, typing


def test_scratch_folder_comes_from_the_session(spark):
    assert spark.conf.get("spark.checkpoint.dir") == scratch_root(spark)


def test_csv_round_trip(spark):
    path = scratch_path(spark, "csv")
    frame = spark.createDataFrame([(1, "a", 1.5), (2, None, 2.5)], "k int, t string, v double")
    tables.write_csv(frame, path)
    assert tables.read_csv(spark, path).schema.simpleString() == "struct<k:int,t:string,v:double>"
    back = tables.read_csv(spark, path, frame.schema)
    assert sorted(back.collect()) == sorted(frame.collect())
    assert tables.read_csv(spark, path, frame.schema, rows=1).count() == 1


def test_partitioned_parquet_is_pruned(spark):
    path = scratch_path(spark, "parts")
    tables.write_parquet(spark.range(10).withColumn("split", F.col("id") % 2), path, ["split"])
    kept = spark.read.parquet(path).filter("split = 1")
    assert kept.count() == 5 and "PartitionFilters: [isnotnull(split" in kept._jdf.queryExecution().toString()


def test_rename_counts_full_matches_only(spark):
    frame = spark.createDataFrame([(1, 2, 3)], "`id-01` int, `id-1` int, `x-id-01` int")
    renamed, n = tables.rename_by_pattern(frame, r"id-\d{2}", "-", "_")
    assert renamed.columns == ["id_01", "id-1", "x-id-01"] and n == 1


def test_records_become_full_width_rows(spark):
    schema = T.StructType([T.StructField("a", T.DoubleType()), T.StructField("t", T.StringType()), T.StructField("z", T.DoubleType())])
    frame = spark.createDataFrame([('{"a": 1, "t": "5", "extra": 9}',), ("{}",)], "r string")
    assert [tuple(r) for r in tables.json_to_columns(frame, "r", schema).collect()] == [(1.0, "5", None), (None, None, None)]


def test_block_members_are_trimmed(spark):
    frame = spark.createDataFrame([("V1, V2 ,,V3",)], "columns string")
    assert tables.block_members(frame).first()["columns"] == ["V1", "V2", "V3"]


def test_bundle_writes_nan_as_null(spark):
    frame = spark.createDataFrame([(2, float("nan")), (1, 0.5)], "k int, v double")
    text = tables.report_bundle({"part": (frame, ["k"])}).first()["bundle"]
    assert text == '{"part":[{"k":1,"v":0.5},{"k":2,"v":null}]}'


def test_narrowing_is_lossless(spark):
    rows = [(i, i * 300, float(i), 2.0**24 + i, i / 3, "ab"[i % 2], f"u{i}") for i in range(10)]
    frame = spark.createDataFrame(rows, "small long, mid long, whole double, big double, part double, rep string, uniq string")
    plan = {r["column"]: r for r in typing.narrowing_plan(frame, {"part": "double"}).collect()}
    assert {c: r["narrow_type"] for c, r in plan.items()} == {
        "small": "tinyint", "mid": "smallint", "whole": "float", "big": "double", "part": "double",
        "rep": "string", "uniq": "string",
    }
    assert plan["rep"]["is_category"] and not plan["uniq"]["is_category"]
    narrow = typing.apply_narrowing(frame, typing.narrowing_plan(frame, {"part": "double"}))
    assert [tuple(r) for r in narrow.collect()] == [tuple(r) for r in frame.collect()]


def test_numeric_coercion_keeps_text(spark):
    frame = spark.createDataFrame([("1", "1", None), (None, "x", None)], "a string, b string, c string")
    got = {r["column"]: r["target_type"] for r in typing.numeric_coercion_plan(frame, ["a", "b", "c"]).collect()}
    assert got == {"a": "double", "b": "string", "c": "double"}


def test_enrichment_marks_matches_of_empty_rows(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, None)], "k int, v string")
    got = {r["k"]: r["f"] for r in J.enrich_one_to_one(left, right, "k", "f").collect()}
    assert got == {1: 1, 2: 0}


@pytest.mark.parametrize("repeat_left", [True, False])
def test_enrichment_refuses_repeated_keys(spark, repeat_left):
    once, twice = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1,), (1,)], "k int")
    left, right = (twice, once) if repeat_left else (once, twice)
    with pytest.raises(PySparkException, match="not unique"):
        J.enrich_one_to_one(left, right, "k", "f").count()


def test_contract_reports_all_failures(spark):
    frame = spark.createDataFrame([(1, 0), (1, 1), (2, 2)], "k int, v int")
    row = J.join_contract(frame, "k", 4, 2).first()
    assert not row["rows_match"] and row["columns_match"] and not row["keys_unique"] and not row["passed"]
    assert row["duplicate_keys"] == 1


def test_lookup_serves_hot_and_cold_labels(spark):
    labels = ["hot"] * 60 + [f"c{i}" for i in range(30)] + ["new", None]
    facts = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "id int, label string")
    table = spark.createDataFrame(
        [("hot", 0.6, 1)] + [(f"c{i}", 0.01, i + 2) for i in range(30)], "l string, share double, code int"
    )
    small = J.lookup_join(facts, "label", table, "l", 31)
    split = J.lookup_join(facts, "label", table, "l", 31, scale=TINY)
    rows, size = J.lookup_size(table, "l")
    assert rows == 31 and size == 31 * 48 + 3 + 10 * 2 + 20 * 3
    assert J.lookup_size(table.filter("false"), "l") == (0, 0)
    tight = replace(SCALE, broadcast_bytes=size - 1)
    heavy = J.lookup_join(facts, "label", table, "l", rows, scale=tight, lookup_bytes=size)
    cold = "__cold"
    plan = lambda f: f._jdf.queryExecution().analyzed().toString()
    assert cold in plan(heavy) and cold not in plan(J.lookup_join(facts, "label", table, "l", rows, lookup_bytes=size))
    key = lambda f: sorted((r["id"], r["label"], r["share"], r["code"]) for r in f.select("id", "label", "share", "code").collect() if r["code"])
    assert key(heavy) == key(small)
    assert key(small) == key(split) and len(key(split)) == 90 and split.count() == 92


def test_null_blocks(transactions):
    columns = ["V1", "V4", "V2", "P_emaildomain", "V3", "V5"]
    got = P.null_pattern_blocks(transactions, "TransactionID", columns).collect()
    assert [r["columns"] for r in got] == ["V1, V2, V3", "V4, V5", "P_emaildomain"]


def test_same_count_is_not_the_same_pattern(spark):
    frame = spark.range(100).select("id", F.when(F.col("id") < 50, 1).alias("a"), F.when(F.col("id") >= 50, 1).alias("b"))
    assert P.null_pattern_blocks(frame, "id", ["a", "b"]).count() == 2


def test_profile_counts(transactions):
    rows = {r["column"]: r for r in P.column_profile(transactions, scale=TINY).collect()}
    assert rows["ProductCD"]["unique_count"] == 5 and rows["ProductCD"]["min_value"] is None
    assert rows["V1"]["family"] == "vesta_V" and rows["V1"]["missing_count"] == rows["V2"]["missing_count"]
    assert rows["flat"]["family"] == "unmapped" and rows["card1"]["unique_count"] == 100
    near = {r["column"]: r for r in P.column_profile(transactions, approximate_distinct=True).collect()}
    assert near["ProductCD"]["unique_count"] == 5 and abs(near["card1"]["unique_count"] - 100) <= 3


def test_category_share_near_its_limit_is_counted(spark):
    n = 20_000
    frame = spark.range(n).select(
        F.pmod("id", F.lit(n // 2 - 1)).cast("string").alias("below"),
        F.pmod("id", F.lit(n // 2)).cast("string").alias("at"),
        F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("null_tips"),
        F.col("id").cast("string").alias("free"),
        F.lit("x").alias("same"),
        F.lit(None).cast("string").alias("none"),
    )
    got = {r["column"]: r["is_category"] for r in typing.narrowing_plan(frame).collect()}
    assert got == {"below": True, "at": False, "null_tips": False, "free": False, "same": True, "none": True}
    none = {r["column"]: r["is_category"] for r in typing.narrowing_plan(frame.filter("false")).collect()}
    assert not any(none.values()) and len(none) == 6


def test_sketches_of_parts_merge_within_their_bounds(spark, transactions):
    names = ["ProductCD", "TransactionAmt", "TransactionID", "V1", "P_emaildomain"]
    many = transactions.unionByName(transactions.withColumn("TransactionID", F.col("TransactionID") + 50_000))
    exact = {r["column"]: r["unique_count"] for r in P.column_profile(many.select(*names)).collect()}
    parts = P.distinct_sketches(many, names, F.when(F.col("card1") % 9 != 0, F.col("card1") % 9))
    path = scratch_path(spark, "sketches")
    parts.write.parquet(path)
    for table, count in ((spark.read.parquet(path), 9), (P.distinct_sketches(many, names), 1)):
        got = {r["column"]: r for r in P.merged_distinct(table).collect()}
        assert set(got) == set(names) and all(r["parts"] == count for r in got.values())
        for name, r in got.items():
            assert r["unique_low"] <= exact[name] <= r["unique_high"] <= r["rows"]
            assert abs(r["unique_estimate"] - exact[name]) <= 0.03 * exact[name]
    none = spark.createDataFrame([(None,), (None,)], "x string")
    assert P.merged_distinct(P.distinct_sketches(none, ["x"])).first()["unique_high"] == 0
    assert P.distinct_sketches(none.filter("false"), ["x"], F.lit("a")).count() == 0


def test_distinct_counts_are_exact_where_asked(transactions):
    frame = transactions.select("TransactionID", "card1", "V1")
    mixed = P.column_profile(frame, approximate_distinct=True, exact_distinct=["card1"])
    rows = {r["column"]: r["unique_count"] for r in mixed.collect()}
    assert rows["card1"] == 100 and abs(rows["TransactionID"] - 3000) <= 90
    plan = P.column_profile(frame, approximate_distinct=True)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(column" not in plan


def test_rate_table_counts_missing_and_drops_rare(transactions):
    rows = P.rate_by_category(transactions, "P_emaildomain", "isFraud", 500).collect()
    assert {r["category"] for r in rows} == {"gmail.com", "yahoo.com", "hotmail.co.uk", "(missing)"}
    assert [r["rate"] for r in rows] == sorted((r["rate"] for r in rows), reverse=True)
    assert P.rate_by_category(transactions, "P_emaildomain", "isFraud", 500, top=2).count() == 2
    assert P.rate_by_category(transactions, "TransactionID", "isFraud", 2).count() == 0


def test_constant_and_dominant(spark):
    frame = spark.createDataFrame([(1, None, "a", None), (1, None, "b", None), (None, None, "a", "x")], "one int, none int, two string, gap string")
    got = {r["column"] for r in C.constant_columns(frame, frame.columns).collect()}
    assert got == {"one", "none", "gap"}
    top = {r["column"]: r for r in C.dominant_value(P.value_counts_long(frame, frame.columns)).collect()}
    assert top["gap"]["dominant_value"] is None and top["gap"]["dominant_rows"] == 2
    assert top["two"]["dominant_value"] == "a"


@pytest.mark.parametrize("buckets", [1, 64, 4096])
def test_dominant_values_by_bounds_equal_those_of_all_counts(spark, buckets):
    rows = [
        (
            i, float(i % 700) if i % 3 else 59.0, None if i % 4 else f"v{i}", "same",
            None, ["b", "a"][i % 2], -0.0 if i % 2 else 0.0, "only" if i == 5 else None, i % 7,
        )
        for i in range(2000)
    ]
    names = ["id", "amount", "mostly_null", "flat", "none", "tied", "zeros", "single", "y"]
    frame = spark.createDataFrame(
        rows, "id long, amount double, mostly_null string, flat string, none string, tied string, zeros double, single string, y long"
    ).repartition(5)
    scale = replace(SCALE, value_buckets=buckets, unpivot_columns=3)
    for table in (frame, frame.union(frame), frame.filter("id = 7"), frame.filter("false")):
        whole = C.dominant_value(P.value_counts_long(table, names[:-1], [F.sum("y").alias("y")]), ["y"])
        want = {r["column"]: r.asDict() for r in whole.collect()}
        got = {r["column"]: r.asDict() for r in C.dominant_by_bounds(table, names[:-1], ["y"], scale).collect()}
        assert set(got) == set(want)
        for name, row in got.items():
            assert row.pop("is_constant") == (want[name].pop("distinct_values") <= 1)
            assert row == want[name]


def test_only_values_that_can_be_the_most_frequent_are_counted(spark, monkeypatch):
    frame = spark.range(40_000).select(
        F.when(F.col("id") % 50 == 0, 59).otherwise(F.col("id")).alias("peaked"), F.lit(1).alias("flat")
    )
    counted, whole = [], C.dominant_value

    def seen(counts, *args):
        counted.append({r["column"]: r["count"] for r in counts.groupBy("column").count().collect()})
        return whole(counts, *args)

    monkeypatch.setattr(C, "dominant_value", seen)
    top = {r["column"]: r for r in C.dominant_by_bounds(frame, ["peaked", "flat"]).collect()}
    assert top["peaked"]["dominant_value"] == "59" and top["peaked"]["dominant_rows"] == 801
    # 39,200 different values, of which those of one bucket were counted
    assert len(counted) == 1 and counted[0]["peaked"] < 100 and counted[0]["flat"] == 1


def test_buckets_that_may_hold_the_best_are_counted_next(spark):
    # the fuller of two buckets holds many rare values, the other the most frequent one
    halves = spark.range(64).select("id", F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(16)).alias("b")).collect()
    crowd = [r["id"] for r in halves if r["b"] == halves[0]["b"]]
    other = next(r["id"] for r in halves if r["b"] != halves[0]["b"])
    frame = spark.createDataFrame([(v,) for v in crowd * 20 + [other] * 21], "x long")
    top = C.dominant_by_bounds(frame, ["x"], scale=replace(SCALE, value_buckets=16)).first()
    assert len(crowd) > 2 and top["dominant_value"] == str(other) and top["dominant_rows"] == 21
    # two values in one bucket, each rarer than null, are not a constant
    frame = spark.createDataFrame([(v,) for v in crowd[:2] * 10 + [None] * 15], "x long")
    top = C.dominant_by_bounds(frame, ["x"], scale=replace(SCALE, value_buckets=16)).first()
    assert top["dominant_value"] is None and top["dominant_rows"] == 15 and not top["is_constant"]


def test_rescue_both_ways(spark):
    n = 20_000
    frame = spark.range(n).select(
        F.when(F.col("id") % 20 == 0, 1).otherwise(0).alias("y"),
        F.when(F.col("id") % 120 == 0, 1).otherwise(0).alias("risky"),
        F.when(F.col("id") % 121 == 1, F.lit(None)).otherwise(0).alias("plain"),
        F.when(F.col("id") % 200 == 7, 1).otherwise(0).alias("safe"),
        F.when(F.col("id") == 3, 1).otherwise(0).alias("few"),
        (F.col("id") % 3).alias("varied"),
    )
    got = {
        r["column"]: r
        for r in C.near_constant_rescue(frame, "y", ["risky", "plain", "safe", "few", "varied"], min_rare_rows=50).collect()
    }
    assert got["risky"]["decision"] == "keep" and got["risky"]["lift"] == 20.0
    assert got["plain"]["decision"] == "drop" and got["plain"]["reason"].endswith("unremarkable")
    assert got["safe"]["decision"] == "keep" and got["safe"]["lift"] == 0.0
    assert got["few"]["reason"] == "near-constant, only 1 rare rows"
    assert got["varied"]["reason"] == "not near-constant" and got["varied"]["lift"] is None


def test_blocks_reduce(spark, transactions):
    kept, evidence = C.block_reduce(transactions, [["V1", "V2", "V3"], ["V4", "V5", "V6"], ["flat"], ["absent"]])
    assert len(kept) == 3 and kept[2] == "flat"
    rows = evidence.collect()
    assert [r["n_represented"] for r in rows] == [3, 3, 1]
    never = transactions.select(F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b"))
    assert C.block_reduce(never, [["a", "b"]])[0] == ["a"]


def test_a_nan_is_no_complete_row_of_a_block(spark):
    # a and b agree wherever both are numbers; NaN rows must count for neither side
    frame = spark.range(400).select(
        F.col("id").cast("double").alias("a"),
        F.when(F.col("id") % 2 == 0, float("nan")).otherwise(F.col("id") * 2.0).alias("b"),
    )
    kept, evidence = C.block_reduce(frame, [["b", "a"]])
    assert kept == ["b"] and evidence.first()["n_represented"] == 2
    only = frame.select("a", F.lit(float("nan")).alias("b"))
    assert C.block_reduce(only, [["a", "b"]])[0] == ["a"]


def test_a_summary_is_run_once_and_broadcast_by_its_rows(spark):
    plan = lambda f: f._jdf.queryExecution().analyzed().toString()
    for rows, small in ((10, True), (11, False), (0, True)):
        out = J.broadcast_if_small(spark.range(rows), limit=10)
        assert "Range" not in plan(out) and ("broadcast" in plan(out)) == small and out.count() == rows


def test_correlation_of_a_constant_is_null(transactions):
    row = C.block_correlation(transactions, ["V4", "flat"]).first()
    assert row["r"] is None


def test_greedy_order_matters():
    m = [[1, 0.8, 0.1], [0.8, 1, 0.9], [0.1, 0.9, 1]]
    assert C.greedy_clusters(m, 0.75) == [[0, 1], [2]]
    assert C.greedy_clusters([[1, float("nan")], [float("nan"), 1]], 0.75) == [[0], [1]]
