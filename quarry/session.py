"""Session construction and table access.

The library never creates a session behind the caller's back: every operator
takes DataFrames.  ``get_session`` is for scripts, tests and the bench; on a
cluster the caller's session (with its own ``spark.checkpoint.dir``) is used.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "quarry") -> SparkSession:
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared scratch folder: ``spark.checkpoint.dir`` of the session, used as is.

    A session without it gets a folder of its own only in local mode, where the
    driver and the tasks are one process; on a cluster it is an error, because
    a machine-local folder would lose rows.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="quarry-ckpt-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, kind: str = "lineage") -> str:
    """A new, unused path in the shared scratch folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/quarry-{kind}/{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system (works for any store)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut_lineage(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """Cut the lineage with a table written to the shared checkpoint folder and
    read back (survives executor loss; the new plan is a plain parquet scan, so
    iterative loops keep a constant plan size).  ``replaces`` is the table of an
    earlier round that nothing reads any more once this one is written."""
    spark = df.sparkSession
    path = scratch_path(spark)
    with shuffles_dropped(spark):       # the table is all that is read from here on
        df.write.parquet(path)
    out = stored(spark, path, df.schema)
    if replaces is not None:
        drop_lineage(replaces)
    return out


def stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table in a scratch path, known by it to ``drop_lineage``."""
    out = spark.read.schema(schema).parquet(path)
    out._quarry_path = path
    return out


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffled files of queries that run inside go when each query ends (the session's setting comes back
    afterwards); otherwise they stay until the driver's garbage is collected."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)


def drop_lineage(df: DataFrame) -> None:
    """Delete the table behind a frame that ``cut_lineage`` returned."""
    path = getattr(df, "_quarry_path", None)
    if path:
        drop_path(df.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
