"""What the operators of this subpackage share: inputs, folds, small checks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:  # workers that need no pandas hold none
    import pandas as pd

# Space, tab and the other ASCII white space; as Java and Python patterns.
SPACE = r"[\x20\x09-\x0D]+"

# Rows travel to Python in batches of so many bytes, however long their texts are.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8_000_000


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text alone, a null text as an empty one.

    Further columns, whatever their names, never reach an operator.
    """
    conf = docs.sparkSession.conf
    if conf.get(BATCH_KEY) != f"{BATCH_BYTES}b":
        conf.set(BATCH_KEY, f"{BATCH_BYTES}b")
    return docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )


def fold(modulus: int) -> Column:
    """crc32 of the id as text modulo the number of folds; a null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus)), F.lit(0))


def parts(frames: Iterator[pd.DataFrame], column: str, chars: int) -> Iterator[pd.DataFrame]:
    """The rows of a task in pieces of about so many characters, to bound its memory."""
    for frame in frames:
        sizes = frame[column].str.len().fillna(0).to_numpy(dtype=np.int64)
        piece = np.cumsum(sizes) // chars
        cuts = np.flatnonzero(np.diff(piece)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(frame)], strict=True):
            if b > a:
                yield frame.iloc[a:b]


def give_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` for the rows of a task, that hands freed memory back to the system at its end.

    Spark keeps Python workers for later tasks; what one task needed at its peak would
    otherwise stay theirs, beside the memory of the stages that follow."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
        if trim:
            trim(0)

    return whole


def per_row(
    frame: DataFrame, column: str, compute: Callable[[list], dict[str, list]], adds: str, carry: str = "doc_id",
    chars: int = 4_000_000,
) -> DataFrame:
    """`carry` as it is, beside new columns computed from the values of `column`.

    Values are handed over in pieces of about `chars` characters.
    """

    kind = frame.schema[carry].dataType.simpleString()
    names = [part.split()[0] for part in adds.split(",")]
    schema = f"{carry} {kind}, {adds}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, int(batch.num_rows * chars / max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, rows):
                piece = batch.slice(at, rows)
                values = piece.column(column).to_pylist()
                found = compute(values)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(carry), *[pa.array(found[n]) for n in names]], names=[carry, *names]
                )

    return frame.select(carry, column).mapInArrow(give_back(run), schema)
