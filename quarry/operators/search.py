"""Parameter grids and their search (JOI-7, AGG-9, WIN-4/5, PIPE-3..5).

Configurations are rows keyed by ``config_id`` (itertools.product order, the
first parameter varying slowest), so every configuration advances in the
same Spark jobs instead of a driver loop; failures become a NULL score with
an ``error`` string (PIPE-5) rather than an exception.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.session import cut_lineage


def param_grid(spark: SparkSession, params: dict[str, list]) -> DataFrame:
    """Cartesian product of parameter lists by successive ``posexplode``
    (no join); ``config_id`` = position in product order.  ``None`` values
    are kept (e.g. ``max_cluster_size=None`` = unbounded)."""
    df = spark.range(1).select(F.lit(0).cast("long").alias("config_id"))
    for name, values in params.items():
        arr = F.array(*[F.lit(v) for v in values])
        df = df.select("*", F.posexplode(arr).alias(f"_i_{name}", name))
        df = df.withColumn("config_id", F.col("config_id") * F.lit(len(values)) + F.col(f"_i_{name}")) \
            .drop(f"_i_{name}")
    return df


def best_config(scores: DataFrame, score_col: str = "score", maximize: bool = True,
                params: list[str] | None = None) -> DataFrame:
    """AGG-9: the best configuration under strict improvement, so the first
    configuration (smallest ``config_id``) wins ties; NULL and NaN scores skipped."""
    ok = scores.where(F.col(score_col).isNotNull() & ~F.isnan(score_col))
    cols = ["config_id"] + [c for c in (params or []) if c != "config_id"] + [score_col]
    rec = F.struct(*cols)
    if maximize:
        pick = F.max_by(rec, F.struct(F.col(score_col), -F.col("config_id")))
    else:
        pick = F.min_by(rec, F.struct(F.col(score_col), F.col("config_id")))
    return ok.agg(pick.alias("_b")).select("_b.*")


def best_so_far(scores: DataFrame, score_col: str = "score", maximize: bool = True) -> DataFrame:
    """WIN-4: running best over configurations in ``config_id`` order.  The
    window spans the configuration table only (one row per config)."""
    s = F.when(~F.isnan(score_col), F.col(score_col))
    w = Window.orderBy("config_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    agg = F.max(s) if maximize else F.min(s)
    return scores.select("config_id", F.col(score_col), agg.over(w).alias("best_so_far"))


def score_curve(scores: DataFrame, score_col: str = "score") -> DataFrame:
    """WIN-5: sorted score curve (rank 0.. by ascending score, ties by config)."""
    ok = scores.where(F.col(score_col).isNotNull() & ~F.isnan(score_col))
    w = Window.orderBy(F.col(score_col), F.col("config_id"))
    return ok.select((F.row_number().over(w) - 1).cast("bigint").alias("rank"), "config_id", F.col(score_col))


def score_labelings(labels: DataFrame, cols: list[str], id_col: str = "id") -> DataFrame:
    """PIPE-4/5: ``(config_id, n_clusters, n_noise, score, error)`` of labels ``(config_id, id, cols, label)``: the
    silhouette (noise is an ordinary label) or why there is none.  Settings that give equal labels, known by two
    hashes over all rows, are scored once."""
    from quarry.operators.metrics import silhouette
    marks = [F.bit_xor(F.xxhash64(F.lit(s), id_col, *cols, "label")).alias(f"_h{s}") for s in (1, 2)]
    known = cut_lineage(labels.groupBy("config_id").agg(
        F.countDistinct(F.when(F.col("label") != -1, F.col("label"))).alias("n_clusters"),
        F.sum((F.col("label") == -1).cast("bigint")).alias("n_noise"), *marks))
    first = known.groupBy("_h1", "_h2").agg(F.min("config_id").alias("_first"))
    scored = silhouette(labels.join(F.broadcast(first.select(F.col("_first").alias("config_id"))), "config_id"),
                        cols, "label", id_col, by=["config_id"])
    return known.join(first, ["_h1", "_h2"]).join(scored.withColumnRenamed("config_id", "_first"), "_first") \
        .select("config_id", "n_clusters", "n_noise", "score", "error")
