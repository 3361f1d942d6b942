"""Stateful streaming exact deduplication.

Documents arrive as a stream.  Its state, kept on disk by the RocksDB state
store and never expired, is keyed by the digest of the normalised text and
retains the smallest stable identifier, the locator of that row's content (file
and row number) and the number of rows.  Copies are combined inside each task
before they reach the state, so a text with a third of all rows sends it one
row per task.  Every hit is then checked: the content found through the locator
is compared byte by byte, and texts that only share the digest are told apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.llm.common import SPACE
from txrisk.session import materialise, scratch_path

STORE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # many small stores: no megabytes set aside for each
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # a store closes with its task; else all stay open beside later work until the next maintenance
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def normalised(text: Column) -> Column:
    """White space runs as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _rows(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    return docs.select(
        "doc_id",
        normalised(F.col("text")).alias("text"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    ).withColumn("digest", digest(F.col("text")))


def advance(
    spark: SparkSession, path: str, state: str, digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """Feeds all files of `path` that the state has not seen yet to it.

    `state` is the folder of the stream's checkpoint; called again after files
    were added, only those are read.  Returns the state: digest, first (the
    smallest doc_id, its file and row; null ids last), copies.
    """
    schema = spark.read.parquet(path).select("doc_id", "text").schema
    path = path.rstrip("/")
    files = f"{path[:-1]}[{path[-1]}]"  # as a pattern a stream may name a single file, too
    with _settings(spark, STORE):
        # an added file may be older than those seen by more than the default of a week
        source = spark.readStream.schema(schema).option("maxFileAge", "36500d")
        stream = _rows(source.parquet(files), digest)
        first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "row")
        query = (
            stream.groupBy("digest")
            .agg(F.min(first).alias("first"), F.count("*").alias("copies"))
            .writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", state)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        if query.exception():
            raise query.exception()
        kept = spark.read.format("statestore").load(state)
        value = [f.name for f in kept.schema["value"].dataType.fields]
        return kept.select(
            F.col("key.digest").alias("digest"),
            F.col(f"value.{value[0]}").alias("first"),
            F.col(f"value.{value[1]}").alias("copies"),
        )


def deduplicate(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Judges every row of the Parquet folder `path` (columns doc_id, text, any others).

    Returns doc_id, keep_id, group_size, kept, text_sha256, and the locator
    file, row.  Null texts count as empty and are copies of each other; of rows with
    equal text and equal id the first by locator stays; a null id stays only
    where all of the group are null; an empty table gives no row.
    """
    index = materialise(advance(spark, path, scratch_path(spark, "dedup-state"), digest), "dedup-index")
    rows = _rows(spark.read.parquet(path), digest)
    at = index.filter("copies > 1").select(
        F.col("digest").alias("d"), F.col("first.file").alias("f"), F.col("first.row").alias("r")
    )
    content = rows.join(at, (F.col("digest") == F.col("d")) & (F.col("file") == F.col("f")) & (F.col("row") == F.col("r")))
    known = index.join(content.select("digest", F.col("text").alias("content")), "digest", "left")
    found = rows.join(known, "digest").withColumn("same", (F.col("copies") == 1) | (F.col("text") == F.col("content")))
    judged = materialise(
        found.select(
            "doc_id", "digest", "file", "row", "first", "copies", "same",
            sha256(F.col("text")).alias("text_sha256"),
            F.when(~F.col("same"), F.col("text")).alias("other"),
        ),
        "dedup-judged",
    )
    others = judged.filter(~F.col("same"))
    if others.isEmpty():
        groups = judged
    else:  # texts that share a digest with another text form groups of their own
        first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "row")
        own = others.groupBy("digest", "other").agg(F.min(first).alias("own"), F.count("*").alias("own_copies"))
        gone = own.groupBy("digest").agg(F.sum("own_copies").alias("gone"))
        apart = others.drop("first", "copies").join(own, ["digest", "other"])
        together = judged.filter("same").join(gone, "digest", "left")
        columns = ["doc_id", "file", "row", "text_sha256"]
        groups = together.select(
            *columns, "first", (F.col("copies") - F.coalesce("gone", F.lit(0))).alias("copies")
        ).unionByName(
            apart.select(*columns, F.col("own").alias("first"), F.col("own_copies").alias("copies"))
        )
    return groups.select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        F.col("copies").alias("group_size"),
        ((F.col("file") == F.col("first.file")) & (F.col("row") == F.col("first.row"))).alias("kept"),
        "text_sha256",
        "file",
        "row",
    )


def _folder(docs: DataFrame) -> str | None:
    """The folder or file that `docs` is a plain scan of, if it is one."""
    files = docs.inputFiles()
    for path in {files[0], files[0].rpartition("/")[0]} if files else ():
        if docs.sparkSession.read.schema(docs.schema).parquet(path).sameSemantics(docs):
            return path
    return None


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns.

    Documents that are not a plain Parquet scan are written first, as the stream reads files.
    """
    spark = docs.sparkSession
    path = _folder(docs)
    if path is None:
        path = scratch_path(spark, "dedup-input")
        docs.write.parquet(path)
    gone = deduplicate(spark, path).filter(~F.col("kept")).select(F.col("file").alias("__f"), F.col("row").alias("__r"))
    gone = materialise(gone, "copies")  # its size then decides how it is joined
    place = {"__file": F.col("_metadata.file_path"), "__row": F.col("_metadata.row_index")}
    every = spark.read.parquet(path).withColumns(place)
    at = [F.col("__file") == F.col("__f"), F.col("__row") == F.col("__r")]
    return every.join(gone, at, "left_anti").drop("__file", "__row")
