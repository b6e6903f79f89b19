"""Artifact sinks (SNK-2, SNK-3, SNK-4).

Every artifact carries ``run_ts`` as a partition column instead of a clock
named folder, so runs are reproducible (the caller passes the value) and
readers prune by run.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Fixed value: the time pattern of run folders.
RUN_PATTERN = "%Y-%m-%d_%H-%M-%S"


def run_stamp(now: dt.datetime | None = None) -> str:
    """SNK-4 / FN-2: ``YYYY-mm-dd_HH-MM-SS`` (the caller may pass ``now``)."""
    return (now or dt.datetime.now(dt.timezone.utc)).strftime(RUN_PATTERN)


def write_run_csvs(df: DataFrame, path: str, run_ts: str, model_col: str | None = "model") -> None:
    """SNK-2: CSV folders with header, one per model, or one global table (``model_col=None``).  Writing a
    run again replaces its folders and leaves other runs alone."""
    parts = ["run_ts", *([model_col] if model_col else [])]
    (df.withColumn("run_ts", F.lit(run_ts)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("header", True).partitionBy(*parts).csv(path))


def write_vector_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                       mode: str = "overwrite") -> None:
    """SNK-3: the chunk/vector table as parquet, overwritten; ``partition_by=["cell"]``
    for an IVF-partitioned table so probes prune files."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
