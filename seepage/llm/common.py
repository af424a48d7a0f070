"""Words, digests and helpers shared by the operators."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"  # the characters outside [^\x20\x09-\x0D]
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts hold fewer rows than Spark's default, unless the session says so.

    The default of 10,000 rows is tens of megabytes of text at once, in the
    executor and again in each of its Python workers.
    """
    if spark.conf.get(BATCH_SETTING) == "10000":
        spark.conf.set(BATCH_SETTING, "1000")


def typed(df: DataFrame, column: str) -> str:
    """The type of a column, as a schema string writes it."""
    return df.schema[column].dataType.simpleString()


class RowBatches:
    """Arrow batches cut so that the values of one column take about ``limit`` bytes in each.

    Python objects made from a batch stay bounded that way, whatever number of rows
    Spark sends at once and however long the texts are.
    """

    def __init__(self, batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> None:
        self.batches, self.column, self.limit = batches, column, limit

    def __iter__(self) -> Iterator[pa.RecordBatch]:
        for batch in self.batches:
            rows = max(1, batch.num_rows)
            step = max(1, rows * self.limit // max(1, batch.column(self.column).nbytes))
            for at in range(0, batch.num_rows, step):
                yield batch.slice(at, step)


@functools.cache
def _trim() -> Callable[[int], int] | None:
    """The C library's call that gives freed memory back, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which its worker holds no more memory than it uses.

    Python workers stay for later stages, and what their allocators keep counts against
    the executor beside the memory of the stage at work.
    """

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = _trim()
            if trim:
                trim(0)

    return inner


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null, empty and blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, r"[\x20\x09-\x0D]+")
    )


def text_key(text: Column) -> Column:
    """Digest that stands for a whole text; null texts share an empty key."""
    return F.coalesce(F.unhex(F.sha2(text, 256)), F.unhex(F.lit("")))
