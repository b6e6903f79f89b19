"""Corpus JSON envelope (SRC-1, SNK-1, FN-17/18).

The reference stores ``{"queries": [...], "results": {id: {title, abstract,
date, category}}}``.  The reader takes that envelope with an explicit schema,
either as one multi-line object per file or one envelope per line, and
explodes the ``results`` map into rows.  The writer produces the same
envelope, one per line, each holding a bounded bucket of records (ids hashed
into ``ceil(bytes / envelope_bytes)`` buckets), so that no row grows with the
corpus; snapshots are ``snapshot_ts=…`` partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("title", "abstract", "date", "category")])
ENVELOPE = T.StructType([
    T.StructField("queries", T.ArrayType(T.StringType())),
    T.StructField("results", T.MapType(T.StringType(), RECORD)),
])


def read_corpus_json(spark: SparkSession, path: str, multi_line: bool = False,
                     keep_snapshot: bool = False) -> DataFrame:
    """Rows ``(id, title, abstract, date STRING, published_at TIMESTAMP, category)``;
    with ``keep_snapshot`` the ``snapshot_ts`` partition column is kept."""
    r = spark.read.schema(ENVELOPE).option("multiLine", multi_line).json(path)
    cols = [F.explode("results").alias("id", "r")]
    if keep_snapshot and "snapshot_ts" in r.columns:
        cols.append("snapshot_ts")
    e = r.select(*cols)
    extra = ["snapshot_ts"] if keep_snapshot and "snapshot_ts" in e.columns else []
    return e.select("id", "r.title", "r.abstract", "r.date",
                    F.to_timestamp("r.date").alias("published_at"), "r.category", *extra)


def write_corpus_json(df: DataFrame, path: str, queries: list[str], snapshot_ts: str,
                      envelope_bytes: int = 8 << 20, mode: str = "append") -> None:
    """SNK-1: ``df`` has ``id, title, abstract, date, category`` (strings).  Envelopes hold about
    ``envelope_bytes`` of text each.  Of rows that repeat an id the last one stays (in the order of the
    frame's partitions); a null id becomes the key ``null``, as JSON writes it."""
    fields = ("title", "abstract", "date", "category")
    df = df.select(F.coalesce(F.col("id").cast("string"), F.lit("null")).alias("id"), *fields,
                   F.monotonically_increasing_id().alias("_row")) \
        .groupBy("id").agg(F.max_by(F.struct(*fields), "_row").alias("r")).select("id", "r.*")
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)).cast("long")
                for c in ("id", "title", "abstract", "date", "category")), F.lit(64).cast("long"))
    buckets = max(1, math.ceil((df.agg(F.sum(size)).first()[0] or 0) / envelope_bytes))
    rec = F.struct(*[F.col(c).cast("string").alias(c) for c in ("title", "abstract", "date", "category")])
    env = (df.groupBy(F.pmod(F.xxhash64(F.col("id")), F.lit(buckets)).alias("_b"))
           .agg(F.map_from_entries(F.collect_list(F.struct(F.col("id").cast("string"), rec))).alias("results"))
           .select(F.array(*[F.lit(q) for q in queries]).alias("queries"), "results",
                   F.lit(snapshot_ts).alias("snapshot_ts")))
    env.write.mode(mode).partitionBy("snapshot_ts").json(path)
