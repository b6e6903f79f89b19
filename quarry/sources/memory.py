"""In-memory inputs (SRC-12) and the search-parameter sibling table (SNK-1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARAMS_DDL = ("query string, sources array<string>, domains array<string>, language string, period string, "
              "from_date string, to_date string, sort_by string, override_content boolean, use_logs boolean")


def texts_frame(spark: SparkSession, texts: list[str]) -> DataFrame:
    """SRC-12: a small list of texts as ``(id, text)`` rows (ids by position)."""
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def write_search_params(spark: SparkSession, params: dict, path: str, snapshot_ts: str) -> None:
    """SNK-1: the search parameters of a snapshot as a one-row sibling table."""
    cols = [c.split()[0] for c in PARAMS_DDL.split(", ")]
    row = tuple(params.get(c) for c in cols)
    df = spark.createDataFrame([row], PARAMS_DDL).withColumn("snapshot_ts", F.lit(snapshot_ts))
    df.write.mode("append").partitionBy("snapshot_ts").parquet(path)
