"""Scoring of free-form records and live alert volume.

Batch and stream share ``score_records``: the plan is row-independent lookups
and expressions, so a record gets the same score either way.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.functions.scalar import decision, missing_fields
from txrisk.operators.encoding import RiskEncoderModel
from txrisk.operators.modeling import Candidate, score
from txrisk.session import scratch_path
from txrisk.sources.tables import json_to_columns

# Without these five a record is refused.
REQUIRED_FIELDS = ("TransactionID", "TransactionDT", "TransactionAmt", "ProductCD", "card1")


@dataclass
class Scorer:
    """Everything needed to score a record."""

    schema: T.StructType
    required: Sequence[str]
    encoder: RiskEncoderModel
    candidate: Candidate
    model: PipelineModel
    features: Sequence[str]
    threshold: float


def quarantine(frame: DataFrame, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that can be scored, and rows that cannot with the fields they lack."""
    marked = frame.withColumn("missing_fields", missing_fields(list(required)))
    valid = marked.filter(F.size("missing_fields") == 0).drop("missing_fields")
    return valid, marked.filter(F.size("missing_fields") > 0)


def score_records(records: DataFrame, column: str, scorer: Scorer) -> DataFrame:
    """JSON text in, (id, score, decision) out; for a table or a stream.

    Records that lack a required field are left to ``refused_records``.
    """
    typed = json_to_columns(records.select(column), column, scorer.schema)
    valid, _ = quarantine(typed, scorer.required)
    return score_typed(valid, scorer)


def score_typed(valid: DataFrame, scorer: Scorer) -> DataFrame:
    """(id, score, decision) of parsed records that lack no required field."""
    encoded = scorer.encoder.transform(valid)
    spec = scorer.encoder.spec
    scored = score(scorer.candidate, scorer.model, encoded, scorer.features, [spec.id])
    return scored.withColumn("decision", decision("score", scorer.threshold))


def refused_records(
    records: DataFrame, column: str, schema: T.StructType, required: Sequence[str]
) -> DataFrame:
    """The records, as they came, that cannot be scored, with the fields they
    lack (all required ones for text that is no JSON); for a table or a stream.
    Scored and refused rows together are the rows of ``records``."""
    kept = records.select(F.col(column), F.col(column).alias("__record"))
    typed = json_to_columns(kept, column, schema)
    _, refused = quarantine(typed, required)
    return refused.select(F.col("__record").alias(column), "missing_fields")


class ScoreOrRefuse:
    """Sink of a record stream with two outputs: scored and refused records.

    A micro-batch is parsed once and kept while both outputs are written, each to
    the folder of the batch's id, which a repeated batch overwrites.  So after a
    stop at any moment and a restart from the same progress folder every record
    is in exactly one output, once.  A null record, text that is no JSON and a
    record without a required field are refused; an empty batch writes nothing.
    """

    def __init__(self, column: str, scorer: Scorer, out: str):
        self.column, self.scorer = column, scorer
        self.scored, self.refused = f"{out}/scored", f"{out}/refused"
        self.progress = f"{out}/progress"

    def __call__(self, records: DataFrame, batch_id: int) -> None:
        record = F.col(self.column)
        kept = records.select(record, record.alias("__record"))
        typed = json_to_columns(kept, self.column, self.scorer.schema)
        missing = missing_fields(list(self.scorer.required))
        typed = typed.withColumn("__missing", missing).persist()
        try:
            lacking = F.size("__missing") > 0
            valid = typed.filter(~lacking).drop("__missing", "__record")
            refused = typed.filter(lacking).select(
                F.col("__record").alias(self.column), F.col("__missing").alias("missing_fields")
            )
            self.write(score_typed(valid, self.scorer), self.scored, batch_id)
            self.write(refused, self.refused, batch_id)
        finally:
            typed.unpersist()

    def write(self, rows: DataFrame, path: str, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    def run(self, stream: DataFrame) -> None:
        """Process what is available, going on where an earlier run stopped."""
        query = (
            stream.writeStream.foreachBatch(self)
            .option("checkpointLocation", self.progress)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    def outputs(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """Scored and refused records so far, with the batch each came in."""
        scorer = self.scorer
        names = [scorer.encoder.spec.id, "score", "decision"]
        types = {f.name: f.dataType for f in scorer.schema.fields}
        scored = T.StructType(
            [
                T.StructField(names[0], types[names[0]]),
                T.StructField("score", T.DoubleType()),
                T.StructField("decision", T.StringType()),
                T.StructField("batch_id", T.LongType()),
            ]
        )
        refused = f"{self.column} string, missing_fields array<string>, batch_id long"
        return spark.read.schema(scored).parquet(self.scored), spark.read.schema(refused).parquet(self.refused)


def read_stream(
    spark: SparkSession, folder: str, name: str, schema: T.StructType, files_per_batch: int | None = None
) -> DataFrame:
    """A folder of Parquet files as a stream, new files as they arrive."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> str:
    """Process what is available into a Parquet table in the shared folder;
    progress is kept beside it, so a restart goes on where it stopped."""
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    progress = progress_of(out)
    query = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return out


def progress_of(out: str) -> str:
    """Where ``run_to_table`` keeps the progress and state of the table ``out``."""
    return f"{out}-progress"


def alert_volume(
    events: DataFrame, ts: str, score_column: str, threshold: float, expected_rate: float,
    window: str = "7 days",
) -> DataFrame:
    """Rows, alerts and the alert rate against the expected one per window."""
    counted = events.groupBy(F.window(ts, window).alias("w")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(score_column) >= threshold).alias("alerts")
    )
    return _alert_rates(counted, expected_rate)


def _alert_rates(counted: DataFrame, expected_rate: float) -> DataFrame:
    rate = F.col("alerts") / F.col("rows")
    return counted.select(
        F.date_format("w.start", "yyyy-MM-dd").alias("window_start"),
        "rows",
        "alerts",
        rate.alias("alert_rate"),
        F.try_divide(rate, F.lit(expected_rate)).alias("alert_rate_ratio"),
    )


def stream_alert_volume(
    stream: DataFrame, ts: str, score_column: str, threshold: float, expected_rate: float,
    window: str = "7 days", lateness: str = "1 hour",
) -> DataFrame:
    """The same over a stream: a window is final once the watermark passes its
    end, and rows later than that are dropped."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    return alert_volume(timed, ts, score_column, threshold, expected_rate, window)


def with_open_windows(spark: SparkSession, out: str, expected_rate: float) -> DataFrame:
    """The windows a finished run of ``stream_alert_volume`` has closed into the
    table ``out``, and those that its state still holds open; ``final`` tells them
    apart.  No event is read again: the open counts are the stream's own state."""
    state = spark.read.format("statestore").load(progress_of(out))
    open_ = state.select(
        F.col("key").cast("struct<w:struct<start:timestamp,end:timestamp>>").alias("key"),
        F.col("value").cast("struct<rows:bigint,alerts:bigint>").alias("value"),
    ).select("key.w", "value.rows", "value.alerts")
    closed = spark.read.parquet(out).withColumn("final", F.lit(True))
    return closed.unionByName(_alert_rates(open_, expected_rate).withColumn("final", F.lit(False)))
