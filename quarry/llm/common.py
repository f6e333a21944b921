"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.columns import unused
from quarry.sources.shared import materialize, shared_dir

__all__ = ["fold", "give_back", "lean", "materialize", "partitions", "shared_dir", "table", "texts_of", "unused"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(id_col, n: int):
    """crc32 of the id as text (null: empty), modulo n."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % F.lit(n)


def texts_of(batch: pa.RecordBatch, column: str = "text", rows: int = 500) -> Iterator[str | None]:
    """A column's values, some rows at a time: a whole batch's texts are not held twice."""
    for at in range(0, batch.num_rows, rows):
        yield from batch.column(column).slice(at, rows).to_pylist()


def give_back() -> None:
    """Hand freed memory from a worker's allocators back to the system. Workers are used again,
    and what one function has freed would stay beside what the next one takes."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives its memory back when a task's rows are over."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped
