"""Clustering queries over ``embeddings`` (phase 5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators.cluster import assign_to_centroids, dbscan, kmeans_fixed_point, lloyd_step
from quarry.operators.hdbscan import core_distances, hdbscan, spanning_tree
from quarry.operators.vector import mean_vectors_by
from quarry.plans.metrics import XY_SQL, points
from quarry.plans.registry import register
from quarry.session import table

_CENTROIDS = """
cen AS (SELECT label, list(m ORDER BY i) AS cvec FROM (
          SELECT label, i, avg(e) AS m FROM (
            SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS e, unnest(range(len(embedding))) AS i
            FROM embeddings) GROUP BY label, i) GROUP BY label),
dd AS (SELECT e.vec_id, c.label AS cluster,
              list_sum(list_transform(list_zip(CAST(e.embedding AS DOUBLE[]), c.cvec),
                                      lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS distance
       FROM embeddings e, cen c),
asg AS (SELECT vec_id, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance
        FROM dd GROUP BY vec_id)"""


@register("kmeans_assign", sql=f"""
WITH {_CENTROIDS}
SELECT vec_id, cluster, round(distance, 6) AS distance FROM asg""")
def q_kmeans_assign(spark, sf_dir):
    """CLU-1 piece: every embedding assigned to the nearest per-label centroid."""
    emb = table(spark, sf_dir, "embeddings")
    cen = mean_vectors_by(emb, "label", "embedding")
    a = assign_to_centroids(emb, cen, id_col="vec_id", vec_col="embedding", cid_col="label")
    return a.select("vec_id", "cluster", F.round("distance", 6).alias("distance"))


@register("lloyd_step", sql=f"""
WITH {_CENTROIDS},
nv AS (SELECT a.cluster, i, avg(e) AS m, count(*) AS n FROM (
         SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS e, unnest(range(len(embedding))) AS i
         FROM embeddings) x JOIN asg a USING (vec_id) GROUP BY a.cluster, i)
SELECT cluster, max(n) AS n, list(round(m, 6) ORDER BY i) AS centroid,
       (SELECT round(sum(distance), 6) FROM asg WHERE asg.cluster = nv.cluster) AS inertia
FROM nv GROUP BY cluster""")
def q_lloyd_step(spark, sf_dir):
    """CLU-1 piece: one Lloyd iteration from the per-label centroids."""
    emb = table(spark, sf_dir, "embeddings")
    cen = mean_vectors_by(emb, "label", "embedding")
    s = lloyd_step(emb, cen, id_col="vec_id", vec_col="embedding", cid_col="label")
    return s.select("cluster", "n", F.transform("centroid", lambda x: F.round(x, 6)).alias("centroid"),
                    F.round("inertia", 6).alias("inertia"))


def _race(draw: str, weight: str) -> str:
    return f"-ln((('0x' || substr(md5('123:' || {draw} || ':' || p.id), 1, 8))::BIGINT + 0.5) / 4294967296.0) / {weight}"


_D2 = "list_transform(list_zip(s.cx, s.cy), lambda z: (p.x - z[1]) * (p.x - z[1]) + (p.y - z[2]) * (p.y - z[2]))"


@register("kmeans_labels", sql=f"""
WITH RECURSIVE pts AS ({XY_SQL}),
s(n, cx, cy) AS (
  SELECT 1, [x], [y] FROM (SELECT x, y FROM pts p ORDER BY {_race("'0'", "1.0")}, p.id LIMIT 1)
  UNION ALL
  SELECT n + 1, list_append(cx, x), list_append(cy, y) FROM (
    SELECT s.n, s.cx, s.cy, p.x, p.y, row_number() OVER (ORDER BY {_race("s.n::VARCHAR", f"list_min({_D2})")}, p.id) AS rn
    FROM s, pts p WHERE s.n < 5 AND list_min({_D2}) > 0) WHERE rn = 1),
l(step, cx, cy) AS (
  SELECT 0, cx, cy FROM s WHERE n = 5
  UNION ALL
  SELECT step + 1, nx, ny FROM (
    SELECT step, any_value(cx) AS cx, any_value(cy) AS cy, list(mx ORDER BY c) AS nx, list(my ORDER BY c) AS ny FROM (
      SELECT step, any_value(cx) AS cx, any_value(cy) AS cy, c, round(avg(x), 9) AS mx, round(avg(y), 9) AS my FROM (
        SELECT s.step, s.cx, s.cy, p.x, p.y, list_position({_D2}, list_min({_D2})) AS c FROM l s, pts p) GROUP BY step, c)
    GROUP BY step) WHERE nx <> cx OR ny <> cy),
f AS (SELECT arg_max(cx, step) AS cx, arg_max(cy, step) AS cy FROM l)
SELECT p.id AS vec_id, round(p.x, 6) AS pc_0, round(p.y, 6) AS pc_1,
       CAST(list_position({_D2}, list_min({_D2})) - 1 AS INTEGER) AS cluster FROM f s, pts p""")
def q_kmeans_labels(spark, sf_dir):
    """CLU-1: seeded k-means++ (k=5), then Lloyd steps to a fixed point, on the plane of ``points``."""
    p = points(spark, sf_dir)
    lab, _ = kmeans_fixed_point(p.select("id", F.array("x", "y").alias("v")), 5, id_col="id", vec_col="v")
    return p.join(lab.select("id", "cluster"), "id").select(
        F.col("id").alias("vec_id"), F.round("x", 6).alias("pc_0"), F.round("y", 6).alias("pc_1"), "cluster")


@register("core_distance", sql=f"""
WITH pts AS ({XY_SQL}),
d AS (SELECT a.id, b.id AS bid, sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2) AS dist FROM pts a, pts b),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, bid) AS rk FROM d)
SELECT id, round(dist, 6) AS core_distance FROM r WHERE rk = 5""")
def q_core_distance(spark, sf_dir):
    """CLU-2 step 1: HDBSCAN core distance (min_samples = 5, self counted) in 2-D, by tiles within reach."""
    c = core_distances(points(spark, sf_dir), [5], key="id", x="x", y="y")
    return c.select("id", F.round("core", 6).alias("core_distance"))


DBSCAN_SQL = """
WITH RECURSIVE pts AS ({xy}),
nb AS (SELECT a.id AS i, b.id AS j FROM pts a JOIN pts b
       ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= CAST({eps} AS DOUBLE) * CAST({eps} AS DOUBLE)),
core AS (SELECT i FROM nb GROUP BY i HAVING count(*) >= {ms}),
ce AS (SELECT nb.i, nb.j FROM nb JOIN core ci ON ci.i = nb.i JOIN core cj ON cj.i = nb.j),
reach(i, r) AS (SELECT i, i FROM core UNION SELECT reach.i, ce.j FROM reach JOIN ce ON ce.i = reach.r),
comp AS (SELECT i, min(r) AS lab FROM reach GROUP BY i),
border AS (SELECT nb.i, min(comp.lab) AS lab FROM nb JOIN comp ON comp.i = nb.j
           WHERE nb.i NOT IN (SELECT i FROM core) GROUP BY nb.i)
SELECT pts.id, CAST(coalesce(comp.lab, border.lab, -1) AS BIGINT) AS cluster, comp.lab IS NOT NULL AS is_core
FROM pts LEFT JOIN comp ON comp.i = pts.id LEFT JOIN border ON border.i = pts.id"""


@register("dbscan_2d", sql=DBSCAN_SQL.format(eps=0.02, ms=5, xy=XY_SQL))
def q_dbscan_2d(spark, sf_dir):
    """CLU-3 / JOI-6: DBSCAN (eps 0.02, min_samples 5) on the plane of ``points``."""
    p = points(spark, sf_dir)
    return dbscan(p, id_col="id", x="x", y="y", eps=0.02, min_samples=5)


@register("fuzzy_membership")
def q_fuzzy_membership(spark, sf_dir):
    """PROJ-1 steps 1–3: symmetric fuzzy kNN graph (15 neighbours, cosine)."""
    from quarry.operators.project import fuzzy_membership
    emb = table(spark, sf_dir, "embeddings")
    edges, _ = fuzzy_membership(emb, id_col="vec_id", vec_col="embedding", n_neighbors=15)
    return edges


@register("umap_2d")
def q_umap_2d(spark, sf_dir):
    """PROJ-1: 2-D layout (15 neighbours, min_dist 0.1, PCA init, the operator's default rounds)."""
    from quarry.operators.project import umap
    emb = table(spark, sf_dir, "embeddings")
    return umap(emb, id_col="vec_id", vec_col="embedding", n_neighbors=15, min_dist=0.1)


@register("clustering_pipeline")
def q_clustering_pipeline(spark, sf_dir):
    """PIPE-1 / PROJ-3 / JOI-1 / SNK-5: projection → min-max scaling → HDBSCAN → metadata attached 1:1 by id →
    plot-ready frame with cluster string and noise flag."""
    from quarry.operators.pipelines import clustering_pipeline
    emb = table(spark, sf_dir, "embeddings")
    meta = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "source")
    known = emb.select("vec_id").join(meta, "vec_id", "left")
    out = clustering_pipeline(emb, {"n_neighbors": 10, "min_dist": 0.01}, CLUSTERING, id_col="vec_id", vec_col="embedding", data=known)
    return out.select(F.col("vec_id").alias("ID"), "umap_0", "umap_1", "cluster", "noise", "lang", "source")


@register("mreach_mst_weight", sql=f"""
WITH RECURSIVE pts AS ({XY_SQL}),
d AS (SELECT a.id, b.id AS bid, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist FROM pts a, pts b),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, bid) AS rk FROM d),
c AS (SELECT pts.id, x, y, dist AS core FROM pts JOIN r ON r.id = pts.id AND rk = 5),
prim(step, id, key) AS (
  SELECT 0, id, CASE WHEN id = (SELECT min(id) FROM c) THEN 0.0 ELSE 'inf'::DOUBLE END FROM c
  UNION ALL
  SELECT step + 1, w.id, least(w.key, greatest(a.core, b.core, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))))
  FROM (SELECT *, first_value(id) OVER (ORDER BY key, id) AS nid FROM prim) w
  JOIN c a ON a.id = w.id JOIN c b ON b.id = w.nid WHERE w.id <> w.nid),
e AS (SELECT step, min(key) AS weight FROM prim WHERE step > 0 GROUP BY step)
SELECT count(*) AS n_edges, round(sum(weight), 6) AS total_weight FROM e""")
def q_mreach_mst_weight(spark, sf_dir):
    """CLU-2: total weight of the mutual-reachability MST (min_samples 5, 2-D);
    brute-force Kruskal in the tests."""
    mst = spanning_tree(points(spark, sf_dir), id_col="id", x="x", y="y", min_samples=5)
    return mst.agg(F.count("*").alias("n_edges"), F.round(F.sum("weight"), 6).alias("total_weight"))


# The clustering settings of the notebooks.
CLUSTERING = {"min_cluster_size": 10, "min_samples": 3, "max_cluster_size": None, "cluster_selection_epsilon": 0.05}


@register("hdbscan_labels")
def q_hdbscan_labels(spark, sf_dir):
    """CLU-2: HDBSCAN labels of every point (sequential version in the tests)."""
    r = hdbscan(points(spark, sf_dir), id_col="id", x="x", y="y", **(CLUSTERING | {"cluster_selection_epsilon": 0.0}))
    return r.select("id", "cluster", (F.col("cluster") == -1).cast("int").alias("noise"))
