"""Grid-search queries: every DBSCAN configuration of a grid clusters the 2-D
embedding components in the same jobs, is scored by silhouette, and the
search summaries (best, best so far, sorted curve) follow (PIPE-4/5, JOI-7,
AGG-9, WIN-4/5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import metrics as M
from quarry.operators.cluster import dbscan
from quarry.operators.hdbscan import cluster_grid
from quarry.operators.search import best_config, best_so_far, param_grid, score_curve, score_labelings
from quarry.plans.metrics import XY_SQL, points, sil_ctes
from quarry.plans.registry import register
from quarry.session import cut_lineage, table

# The DBSCAN grid (product order, first parameter slowest).
DBSCAN_GRID = {"eps": [0.015, 0.02, 0.03], "min_samples": [3, 5, 10]}


def grid_scores(spark, sf_dir):
    cfg = param_grid(spark, DBSCAN_GRID)
    pts = points(spark, sf_dir)
    rep = _replicate(pts, cfg)
    lab = dbscan(rep, id_col="id", x="x", y="y", eps="eps", min_samples="min_samples", config_col="config_id")
    lp = lab.join(pts, "id").select("config_id", "id", "x", "y", F.col("cluster").alias("label"))
    sil = M.silhouette(lp, ["x", "y"], "label", "id", by=["config_id"])
    stats = lab.groupBy("config_id").agg(
        F.countDistinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("n_clusters"),
        F.sum(F.when(F.col("cluster") < 0, 1).otherwise(0)).cast("bigint").alias("n_noise"))
    return cfg.join(stats, "config_id").join(sil, "config_id")


def _replicate(pts, cfg):
    """Points × configurations through an array column of the (tiny) config
    table, literal-inlined — one row per point and configuration."""
    rows = cfg.orderBy("config_id").collect()
    arr = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in cfg.columns]) for r in rows])
    return pts.select("*", F.explode(arr).alias("_cfg")).select(*pts.columns, "_cfg.*")


def _grid_sql() -> str:
    vals = ", ".join(f"({i * 3 + j}, CAST({e} AS DOUBLE), {m})"
                     for i, e in enumerate(DBSCAN_GRID["eps"]) for j, m in enumerate(DBSCAN_GRID["min_samples"]))
    return f"""
cfg AS (SELECT * FROM (VALUES {vals}) t(config_id, eps, min_samples)),
raw AS ({XY_SQL}),
nb AS (SELECT c.config_id, a.id AS i, b.id AS j FROM cfg c, raw a, raw b
       WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= c.eps * c.eps),
core AS (SELECT nb.config_id, i FROM nb JOIN cfg USING (config_id) GROUP BY nb.config_id, i, cfg.min_samples
         HAVING count(*) >= cfg.min_samples),
ce AS (SELECT nb.config_id, nb.i, nb.j FROM nb JOIN core ci ON ci.config_id = nb.config_id AND ci.i = nb.i
       JOIN core cj ON cj.config_id = nb.config_id AND cj.i = nb.j),
reach(config_id, i, r) AS (SELECT config_id, i, i FROM core UNION
                           SELECT reach.config_id, reach.i, ce.j FROM reach JOIN ce ON ce.config_id = reach.config_id AND ce.i = reach.r),
comp AS (SELECT config_id, i, min(r) AS lab FROM reach GROUP BY config_id, i),
border AS (SELECT nb.config_id, nb.i, min(comp.lab) AS lab FROM nb JOIN comp ON comp.config_id = nb.config_id AND comp.i = nb.j
           WHERE NOT EXISTS (SELECT 1 FROM core WHERE core.config_id = nb.config_id AND core.i = nb.i)
           GROUP BY nb.config_id, nb.i),
lab AS (SELECT c.config_id, r.id, coalesce(comp.lab, border.lab, -1) AS cluster FROM cfg c CROSS JOIN raw r
        LEFT JOIN comp ON comp.config_id = c.config_id AND comp.i = r.id
        LEFT JOIN border ON border.config_id = c.config_id AND border.i = r.id),
pts AS (SELECT l.config_id AS g, l.id, r.x, r.y, l.cluster AS label FROM lab l JOIN raw r USING (id)),
{sil_ctes()},
st AS (SELECT config_id, count(DISTINCT CASE WHEN cluster >= 0 THEN cluster END) AS n_clusters,
              CAST(sum(CASE WHEN cluster < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_noise FROM lab GROUP BY config_id),
gs AS (SELECT cfg.config_id, cfg.eps, cfg.min_samples, st.n_clusters, st.n_noise, sil.score, sil.error
       FROM cfg JOIN st USING (config_id) JOIN sil ON sil.g = cfg.config_id)"""


@register("dbscan_grid", sql=f"""
WITH RECURSIVE {_grid_sql()}
SELECT CAST(config_id AS BIGINT) AS config_id, eps, CAST(min_samples AS INTEGER) AS min_samples, n_clusters, n_noise,
       round(score, 6) AS score, error FROM gs""")
def q_dbscan_grid(spark, sf_dir):
    """JOI-7 / PIPE-4 / PIPE-5: 9 DBSCAN configurations in one set of jobs, silhouette each."""
    g = grid_scores(spark, sf_dir)
    return g.select("config_id", "eps", "min_samples", "n_clusters", "n_noise",
                    F.round("score", 6).alias("score"), "error")


@register("best_config", sql=f"""
WITH RECURSIVE {_grid_sql()}
SELECT CAST(arg_max(config_id, (round(score, 6), -config_id)) AS BIGINT) AS config_id,
       arg_max(eps, (round(score, 6), -config_id)) AS eps,
       CAST(arg_max(min_samples, (round(score, 6), -config_id)) AS INTEGER) AS min_samples,
       max(round(score, 6)) AS score
FROM gs WHERE score IS NOT NULL""")
def q_best_config(spark, sf_dir):
    """AGG-9: best configuration by silhouette (strict improvement: first wins ties)."""
    g = grid_scores(spark, sf_dir).withColumn("score", F.round("score", 6))
    return best_config(g, "score", True, ["eps", "min_samples"])


@register("best_so_far", sql=f"""
WITH RECURSIVE {_grid_sql()}
SELECT CAST(config_id AS BIGINT) AS config_id, round(score, 6) AS score,
       max(round(score, 6)) OVER (ORDER BY config_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_so_far
FROM gs""")
def q_best_so_far(spark, sf_dir):
    """WIN-4: best silhouette so far along the search order."""
    g = grid_scores(spark, sf_dir).withColumn("score", F.round("score", 6))
    return best_so_far(g, "score", True)


@register("score_curve", sql=f"""
WITH RECURSIVE {_grid_sql()}
SELECT row_number() OVER (ORDER BY round(score, 6), config_id) - 1 AS rank, CAST(config_id AS BIGINT) AS config_id,
       round(score, 6) AS score FROM gs WHERE score IS NOT NULL""")
def q_score_curve(spark, sf_dir):
    """WIN-5: sorted score curve of the grid."""
    g = grid_scores(spark, sf_dir).withColumn("score", F.round("score", 6))
    return score_curve(g, "score")


# The clustering grid (product order, first parameter slowest).
CLUSTERING_GRID = {"min_cluster_size": [3, 5, 10, 15], "min_samples": [3, 5, 10], "max_cluster_size": [None, 15, 25, 40],
                   "cluster_selection_epsilon": [0.05, 0.1, 0.5]}


@register("hdbscan_grid")
def q_hdbscan_grid(spark, sf_dir):
    """PIPE-4 / PIPE-5 / AGG-9: all 144 HDBSCAN settings on min-max scaled points in one set of jobs (three spanning
    trees), the silhouette or the error of each; ``is_best`` marks the first best one."""
    cfg = param_grid(spark, CLUSTERING_GRID)
    configs = [r.asDict() for r in cfg.orderBy("config_id").collect()]
    scaled = M.minmax_scaled(points(spark, sf_dir).select("id", "x", "y"), ["x", "y"]).select(
        "id", F.col("x_scaled").alias("x"), F.col("y_scaled").alias("y"))
    labels = cut_lineage(cluster_grid(scaled, configs, id_col="id", x="x", y="y").withColumnRenamed("cluster", "label"))
    g = cfg.join(score_labelings(labels, ["x", "y"]), "config_id")
    best = best_config(g, "score").select(F.col("config_id").alias("_best"))
    return g.join(best, F.col("config_id") == F.col("_best"), "left").select(
        "config_id", *CLUSTERING_GRID, "n_clusters", "n_noise", F.round("score", 6).alias("score"), "error",
        F.col("_best").isNotNull().alias("is_best"))


# The projection grid (product order, first parameter slowest).
PROJECTION_GRID = {"n_neighbors": [2, 4, 8, 10], "min_dist": [0.001, 0.01, 0.1, 0.5]}


@register("projection_grid")
def q_projection_grid(spark, sf_dir):
    """PIPE-3 / AGG-9: 16 projection configurations laid out in the same jobs,
    each scored by joint entropy of its 2-D coordinates; ``is_best`` marks the
    first configuration with the lowest entropy (strict improvement)."""
    from quarry.operators.project import umap_grid
    cfg = param_grid(spark, PROJECTION_GRID)
    configs = [r.asDict() for r in cfg.orderBy("config_id").collect()]
    emb = table(spark, sf_dir, "embeddings")
    proj = umap_grid(emb, configs, id_col="vec_id", vec_col="embedding")
    ent = M.joint_entropy(proj, ["umap_0", "umap_1"], by=["config_id"])
    scored = cfg.join(ent.select("config_id", "entropy"), "config_id", "left")
    best = best_config(scored, "entropy", maximize=False).select(F.col("config_id").alias("_best"))
    return scored.join(best, F.col("config_id") == F.col("_best"), "left") \
        .select("config_id", "n_neighbors", "min_dist", F.round("entropy", 6).alias("entropy"),
                F.col("_best").isNotNull().alias("is_best"))
