"""Scans and sinks.  Schemas are given, not inferred, wherever a job repeats."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(
    spark: SparkSession, folder: str, name: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """One Parquet table.  Times without a zone are read as plain timestamps
    (the session is in UTC), which watermarks accept and filters push down."""
    path = f"{folder}/{name}.parquet"
    frame = spark.read.parquet(path)
    if any(isinstance(f.dataType, T.TimestampNTZType) for f in frame.schema.fields):
        frame = spark.read.schema(plain_times(frame.schema)).parquet(path)
    return frame.select(*columns) if columns else frame


def plain_times(schema: T.StructType) -> T.StructType:
    return T.StructType(
        [
            T.StructField(f.name, T.TimestampType(), f.nullable)
            if isinstance(f.dataType, T.TimestampNTZType)
            else f
            for f in schema.fields
        ]
    )


def spread(scan: DataFrame) -> DataFrame:
    """Use all cores on a plain scan that was stored in fewer pieces than that;
    a large table, which has more, is left as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None, rows: int | None = None
) -> DataFrame:
    """CSV with a header.  Without a schema the whole file decides each type;
    take the schema of that first read for every later one."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    frame = reader.csv(path)
    return frame.limit(rows) if rows is not None else frame


def write_csv(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(frame: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = frame.write.mode("overwrite").option("compression", "snappy")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def rename_by_pattern(frame: DataFrame, pattern: str, old: str, new: str) -> tuple[DataFrame, int]:
    """Replace ``old`` by ``new`` in the column names that match in full."""
    renames = {c: c.replace(old, new) for c in frame.columns if re.fullmatch(pattern, c)}
    return frame.withColumnsRenamed(renames), len(renames)


def block_members(blocks: DataFrame, column: str = "columns") -> DataFrame:
    """Turn a comma-separated member list into an array of trimmed names."""
    names = F.transform(F.split(F.col(column), ","), lambda n: F.trim(n))
    return blocks.withColumn(column, F.filter(names, lambda n: n != ""))


_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def json_to_columns(frame: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """Records of free form to one column per known field: absent fields are
    null, unknown ones are dropped, text stays text.

    Every field is read as text first, so numbers may come quoted and whole
    numbers with a fraction of zero; what cannot be read is null.

    The fields of a record come out of a generator: a filter on them, pushed
    through a projection, would parse the record again for each of its terms.
    """
    kept = [c for c in frame.columns if c != column]
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    parsed = F.from_json(F.col(column), raw, {"mode": "PERMISSIVE"})
    names = [f"__r{i}" for i in range(len(schema.fields))]

    def typed(field: T.StructField, name: str) -> Column:
        text = F.col(name)
        if isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)):
            return F.from_json(text, field.dataType)
        if isinstance(field.dataType, _WHOLE):
            number = text.try_cast("double")
            rounded = F.when(number == F.floor(number), number.cast("decimal(38,0)")).try_cast(field.dataType)
            return F.coalesce(text.try_cast(field.dataType), rounded)
        return text.try_cast(field.dataType)

    return frame.select(*kept, F.inline(F.array(parsed)).alias(*names)).select(
        *kept, *[typed(f, n).alias(f.name) for f, n in zip(schema.fields, names)]
    )


def table_inventory(tables: dict[str, DataFrame], expected: dict[str, int] | None = None) -> DataFrame:
    """Rows and columns of each table, with the expected column count beside."""
    parts = [
        t.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table_name"),
            "rows",
            F.lit(len(t.columns)).cast("long").alias("columns"),
            (F.lit(len(t.columns) == (expected or {}).get(name, len(t.columns)))).alias(
                "columns_match"
            ),
        )
        for name, t in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def report_bundle(parts: dict[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """One JSON document with a record list per report table.

    For finished reports only (tens of rows each).  Each list is ordered by
    the given columns; NaN and infinity are written as null.
    """
    cells = []
    for name, (frame, order) in parts.items():
        safe = frame.select(
            *[
                F.when(~F.isnan(f.name) & (F.abs(f.name) < float("inf")), F.col(f.name)).alias(f.name)
                if isinstance(f.dataType, (T.DoubleType, T.FloatType))
                else F.col(f.name)
                for f in frame.schema.fields
            ]
        )
        rest = [c for c in frame.columns if c not in order]
        listed = safe.agg(
            F.sort_array(F.collect_list(F.struct(*order, *rest))).alias("records")
        ).select(F.to_json("records", {"ignoreNullFields": "false"}).alias("records"))
        cells.append(listed.select(F.lit(name).alias("name"), "records"))
    stacked = cells[0]
    for cell in cells[1:]:
        stacked = stacked.unionByName(cell)
    body = F.concat_ws(
        ",",
        F.transform(
            F.sort_array(F.collect_list(F.struct("name", "records"))),
            lambda r: F.concat(F.lit('"'), r["name"], F.lit('":'), r["records"]),
        ),
    )
    return stacked.agg(F.concat(F.lit("{"), body, F.lit("}")).alias("bundle"))
