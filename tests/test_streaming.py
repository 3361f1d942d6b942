import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.operators import encoding as E
from txrisk.operators import modeling as M
from txrisk.session import scratch_path
from txrisk.sources.tables import json_to_columns
from txrisk.streaming import scoring as S


COLUMNS = ["TransactionID", "TransactionDT", "TransactionAmt", "card1", "ProductCD"]
SPEC = E.EncoderSpec(
    address="", age_days="", emails=(), device="", browser="ProductCD", screen="", match=(),
    frequency=("card1",), aggregates=(("card1", "TransactionAmt"),),
)


@pytest.fixture(scope="module")
def scorer(transactions):
    early = transactions.filter("TransactionID < 1002400").select(*COLUMNS, "isFraud")
    encoder = E.RiskEncoder(SPEC).fit(early)
    candidate = M.logistic_candidate("isFraud", 5)
    model = M.fit(candidate, encoder.transform(early), encoder.feature_names, "isFraud")
    schema = transactions.select(*COLUMNS).schema
    return S.Scorer(schema, COLUMNS, encoder, candidate, model, encoder.feature_names, 0.06)


class StopsOnce(S.ScoreOrRefuse):
    """Fails in the second batch, after its scored rows were written."""

    stopped = False

    def write(self, rows, path, batch_id):
        if batch_id == 1 and path == self.refused and not self.stopped:
            self.stopped = True
            raise RuntimeError("stopped in the middle")
        super().write(rows, path, batch_id)


def records_of(transactions):
    """600 records: every third lacks a required field, two are no JSON, one is null."""
    late = transactions.select(*COLUMNS).filter("TransactionID >= 1002400")
    product = F.when(F.col("TransactionID") % 3 != 0, F.col("ProductCD")).alias("ProductCD")
    rest = [c for c in late.columns if c != "ProductCD"]
    made = late.select(F.to_json(F.struct(*rest, product)).alias("record"))
    odd = late.sparkSession.createDataFrame([("no json",), ("",), (None,)], "record string")
    return made.unionByName(odd)


def test_a_stop_between_both_outputs_loses_and_repeats_nothing(spark, transactions, scorer):
    records, folder = records_of(transactions).cache(), scratch_path(spark, "arriving")
    records.repartition(4).write.parquet(folder)
    sink = StopsOnce("record", scorer, scratch_path(spark, "outputs"))
    stream = lambda: S.read_stream(spark, folder, "*.parquet", records.schema, 1)
    with pytest.raises(Exception, match="stopped in the middle"):
        sink.run(stream())
    half, _ = sink.outputs(spark)
    assert {r[0] for r in half.select("batch_id").distinct().collect()} == {0, 1}
    sink.run(stream())
    sink.run(stream())
    scored, refused = sink.outputs(spark)
    assert scored.count() + refused.count() == records.count()
    assert scored.select("batch_id").union(refused.select("batch_id")).distinct().count() == 4
    batch = {r["TransactionID"]: (r["score"], r["decision"]) for r in S.score_records(records, "record", scorer).collect()}
    assert {r["TransactionID"]: (r["score"], r["decision"]) for r in scored.collect()} == batch
    assert scored.count() == len(batch)
    plain = S.refused_records(records, "record", scorer.schema, scorer.required)
    lacking = lambda t: sorted((str(r["record"]), *sorted(r["missing_fields"])) for r in t.collect())
    assert lacking(refused) == lacking(plain)
    assert sum(r["record"] is None for r in refused.collect()) == 1
    records.unpersist()


def test_a_batch_of_refused_records_only(spark, scorer):
    folder = scratch_path(spark, "refused-only")
    spark.createDataFrame([("no json",), (None,)], "record string").coalesce(1).write.parquet(folder)
    sink = S.ScoreOrRefuse("record", scorer, scratch_path(spark, "outputs"))
    sink.run(S.read_stream(spark, folder, "*.parquet", T.StructType([T.StructField("record", T.StringType())])))
    scored, refused = sink.outputs(spark)
    assert scored.count() == 0 and scored.columns == ["TransactionID", "score", "decision", "batch_id"]
    assert refused.count() == 2


def test_open_windows_come_from_the_state(spark):
    """Closed and open windows together count every row that was not late."""
    folder, day = scratch_path(spark, "windows"), "2024-01-{:02d} 00:00:00"
    parts = [[(4, 1.0), (5, 0.0), (12, 1.0)], [(20, 1.0), (21, 0.0)], [(26, 1.0), (20, 1.0)]]
    for rows in parts:
        part = spark.createDataFrame([(day.format(d), s) for d, s in rows], "ts string, score double")
        part.select(F.col("ts").cast("timestamp").alias("ts"), "score").coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    stream = spark.readStream.schema("ts timestamp, score double").option("maxFilesPerTrigger", 1).parquet(folder)
    out = S.run_to_table(S.stream_alert_volume(stream, "ts", "score", 0.5, 0.1), "volume")
    got = {r["window_start"]: (r["rows"], r["alerts"], r["final"]) for r in S.with_open_windows(spark, out, 0.1).collect()}
    assert got == {
        "2024-01-04": (2, 1, True),
        "2024-01-11": (1, 1, True),
        "2024-01-18": (3, 2, True),
        "2024-01-25": (1, 1, False),
    }


def test_a_filter_on_fields_does_not_parse_again(spark):
    """The optimiser may not copy the parser into a filter, once for each term."""
    rows = [('{"a": "1", "b": 2}',), ('{"a": 1}',), ("no json",), (None,), ("",), ('{"a": "x", "b": 3}',)]
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    typed = json_to_columns(spark.createDataFrame(rows, "r string").repartition(2), "r", schema)
    assert sorted(map(tuple, typed.na.fill(-1).collect())) == [(-1, -1)] * 3 + [(-1, 3), (1, -1), (1, 2)]
    valid, refused = S.quarantine(typed, ["a", "b"])
    assert [tuple(r) for r in valid.collect()] == [(1, 2)] and refused.count() == 5
    assert valid._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
