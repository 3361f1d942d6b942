from pyspark.sql import types as T

from txrisk.functions import scalar as X


def one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_labels_do_not_depend_on_storage(spark):
    values = [(315, 315.0, 315.0)]
    row = one(
        spark, values, "a int, b double, c float",
        X.label_text("a", T.IntegerType()), X.label_text("b", T.DoubleType()), X.label_text("c", T.FloatType()),
    )
    assert row == [("315.0", "315.0", "315.0")]


def test_labels_of_odd_numbers(spark):
    rows = [(None,), (float("nan"),), (1e7,), (0.1234567,), (-0.0,), (float("inf"),), (2.50,)]
    got = one(spark, rows, "x double", X.label_text("x", T.DoubleType()))
    assert [g[0] for g in got] == ["(missing)", "(missing)", "10000000.0", "0.123457", "0.0", "Infinity", "2.5"]


def test_amount_and_time_parts(spark):
    row = one(
        spark, [(31.95, 90_000), (40.0, 0)], "a double, s long",
        *X.amount_parts("a"), X.hour_of("s"), X.day_of_week("s"),
    )
    assert [r[1:] for r in row] == [(0.95, 0, 1, 1), (0.0, 1, 0, 0)]


def test_text_parts(spark):
    provider, suffix = X.domain_parts("t")
    got = one(spark, [("yahoo.co.uk",), ("(missing)",)], "t string", provider, suffix)
    assert got == [("yahoo", "co.uk"), ("(missing)", "(missing)")]
    got = one(spark, [("1920x1080",), ("(missing)",), ("12xab",)], "t string", *X.dimension_parts("t"))
    assert got == [(1920.0, 1080.0, 2073600.0), (None, None, None), (12.0, None, None)]
    got = one(spark, [("SAMSUNG SM-G892A Build/NRD90M",), ("A/b c",)], "t string", X.first_token("t"))
    assert got == [("samsung",), ("a",)]


def test_domains_match_has_three_states(spark):
    rows = [("a", "a"), ("a", "b"), ("(missing)", "a")]
    assert one(spark, rows, "l string, r string", X.domains_match("l", "r")) == [(1.0,), (0.0,), (None,)]


def test_decision_includes_the_threshold(spark):
    got = one(spark, [(0.45,), (0.40,), (0.4222,)], "s double", X.decision("s", 0.4222))
    assert got == [("review",), ("pass",), ("review",)]


def test_drift_bands(spark):
    rows = [(None,), (0.05,), (0.1,), (0.25,), (float("nan"),)]
    got = one(spark, rows, "p double", X.drift_band("p"))
    assert [g[0] for g in got] == ["unknown", "stable", "moderate", "significant", "unknown"]


def test_families_match_whole_names(spark):
    from txrisk.operators.profile import FAMILY_NAMES, FAMILY_PATTERNS

    names = ["card1", "C1", "C123", "V339", "id_01", "P_emaildomain", "isFraud", "other", "addr1"]
    got = one(
        spark, [(n,) for n in names], "n string", X.column_family("n", FAMILY_NAMES, FAMILY_PATTERNS)
    )
    assert [g[0] for g in got] == [
        "card", "counting_C", "unmapped", "vesta_V", "identity_id", "email", "target", "unmapped", "address",
    ]


def test_usable_drops_infinities(spark):
    got = one(spark, [(1.0,), (float("inf"),), (float("nan"),), (None,)], "x double", X.usable("x"))
    assert got == [(1.0,), (None,), (None,), (None,)]


def test_entity_key_is_stable_over_time(spark):
    frame = spark.createDataFrame(
        [(1, 5.0, 10 * 86400, 3.0), (1, 5.0, 12 * 86400, 5.0)], "c int, a double, s long, d double"
    )
    keys = {r[0] for r in frame.select(X.entity_key(frame, "c", "a", "s", "d")).collect()}
    assert keys == {"1.0_5.0_7.0"}
