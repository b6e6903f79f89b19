"""Structured Streaming over landed article/event files (STR-1, STR-2).

Driver tables store ``TIMESTAMP_NTZ``; watermarks need ``TIMESTAMP``, so the
event time is cast on the way in and window bounds are cast back on the way
out.  Runs use the ``availableNow`` trigger; sinks and stream checkpoints live
under the shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import ensure_checkpoint_dir


def read_stream(spark: SparkSession, path: str, schema, glob: str | None = None,
                max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.format("parquet").schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def dedup_within_watermark(stream: DataFrame, key: list[str], ts: str, delay: str = "1 day") -> DataFrame:
    """STR-1: continuous ingestion, first arrival of a key kept while the key is
    inside the watermark (batch WIN-1 keeps the last: documented difference)."""
    s = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return s.withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)


def period_counts(stream: DataFrame, ts: str, keys: list[str], length: str = "7 days",
                  slide: str = "1 day", delay: str = "1 day") -> DataFrame:
    """STR-2: sliding-period counts; append mode emits a window once it is
    closed by the watermark; rows later than the watermark are dropped."""
    s = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    g = s.groupBy(F.window(ts, length, slide).alias("w"), *keys).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"), *keys, "n")


@contextlib.contextmanager
def _utc(spark: SparkSession):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def run_available_now(result: DataFrame, name: str, output_mode: str = "append",
                      timeout_s: int | None = None) -> DataFrame:
    """Process everything available, write it to a parquet sink in the shared
    checkpoint folder, and return the sink as a batch DataFrame.  There is no
    limit of time unless the caller sets one."""
    spark = result.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/quarry-stream/{name}-{uuid.uuid4().hex[:12]}"
    with _utc(spark):
        q = (result.writeStream.format("parquet").outputMode(output_mode)
             .option("checkpointLocation", base + "/_checkpoint").option("path", base + "/out")
             .trigger(availableNow=True).start())
        if timeout_s is None:
            q.awaitTermination()
        elif not q.awaitTermination(timeout_s):
            q.stop()
            raise TimeoutError(f"stream {name} did not finish in {timeout_s}s")
        if q.exception():
            raise q.exception()
    return spark.read.schema(result.schema).parquet(base + "/out")
