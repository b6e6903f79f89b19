"""Arrow batch sizes for jobs that an operator runs itself."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_CONF, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"

UNCOUNTED = 2 ** 31 - 1


@contextmanager
def arrow_batches(spark: SparkSession, rows: int, size: int | None = None) -> Iterator[None]:
    """Jobs started inside exchange at most ``rows`` rows (and about ``size`` bytes) at once with Python (the session's
    settings come back afterwards): wide rows stay within a worker's memory.  Spark adds up the bytes of a batch at
    every row, which takes longer than a narrow row itself; ``UNCOUNTED`` leaves that out."""
    before, room = spark.conf.get(_CONF), spark.conf.get(_BYTES)
    spark.conf.set(_CONF, str(min(rows, int(before)) if int(before) > 0 else rows))
    if size:
        spark.conf.set(_BYTES, str(size))
    try:
        yield
    finally:
        spark.conf.set(_CONF, before)
        spark.conf.set(_BYTES, room)
