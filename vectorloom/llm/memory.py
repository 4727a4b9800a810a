"""Keeping Python workers small: modest slices of Arrow batches, and freed memory given back between tasks."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

ROWS_PER_SLICE = 1000
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Rows go to and from Python at most ROWS_PER_SLICE at a time in this session from now on.

    Both sides hold a batch as a whole outside the JVM's heap, and a buffer that grows is held twice for a while.
    """
    if not 0 < int(spark.conf.get(BATCH)) <= ROWS_PER_SLICE:
        spark.conf.set(BATCH, str(ROWS_PER_SLICE))


@functools.lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def release() -> None:
    """Give freed memory of the allocators back to the system; workers are kept between tasks."""
    pa.default_memory_pool().release_unused()
    trim = _trim()
    if trim:
        trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same map function, given at most ROWS_PER_SLICE rows at a time, which releases memory when its task ends."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_PER_SLICE):
                yield batch.slice(at, ROWS_PER_SLICE)

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(sliced(batches))
        release()

    return wrapped
