"""Arrow batches of bounded bytes, so that a worker's memory doesn't grow with its rows."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes and rows of a batch that goes to a worker; rows of one that comes back from a body of many entries.
BATCH_BYTES, BATCH_ROWS, OUT_ROWS = 2 << 20, 1000, 10_000


def bound_batches(spark: SparkSession) -> None:
    """For row functions and map_batches alike: the session's batches are cut by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with bounded batches; the worker gives its memory back after each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from fn(batches)
        finally:
            gc.collect()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)
