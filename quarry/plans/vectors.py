"""Vector-search queries over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators.neighbours import neighbour_descent
from quarry.operators.vector import knn_graph, mean_vectors_by, similarity_search
from quarry.plans.registry import register
from quarry.session import table

# Query vectors = the per-label centroids, derived from the whole table.
_CENTROIDS_SQL = """
centroid AS (
  SELECT label, list(m ORDER BY i) AS cvec FROM (
    SELECT label, i, avg(e) AS m FROM (
      SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS e,
             unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i)
  GROUP BY label)"""


@register("similarity_top4", sql=f"""
WITH {_CENTROIDS_SQL},
d AS (
  SELECT c.label, e.vec_id,
         list_sum(list_transform(list_zip(CAST(e.embedding AS DOUBLE[]), c.cvec),
                                 lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS distance
  FROM embeddings e, centroid c),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS rank FROM d)
SELECT label, rank, vec_id, round(distance, 6) AS distance FROM r WHERE rank <= 4
""")
def similarity_top4(spark, sf_dir):
    """VEC-1 / JOI-4 / WIN-3 / LIM-3: 4 nearest vectors (squared L2) to each label centroid."""
    emb = table(spark, sf_dir, "embeddings")
    cent = mean_vectors_by(emb, "label", "embedding")
    r = similarity_search(emb, cent, 4, id_col="vec_id", vec_col="embedding",
                          query_id_col="label", metric="l2sq")
    return r.select("label", F.col("rank").cast("bigint").alias("rank"), "vec_id",
                    F.round("distance", 6).alias("distance"))


@register("knn_graph_cosine", sql="""
WITH d AS (
  SELECT a.vec_id AS src, b.vec_id AS dst,
         1 - list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))
             / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])))
                * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))))
           AS distance
  FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS rank FROM d)
SELECT src, rank, dst, round(distance, 6) AS distance FROM r WHERE rank <= 10
""")
def knn_graph_cosine(spark, sf_dir):
    """JOI-5: the 10-nearest-neighbour graph of every embedding, cosine distance."""
    emb = table(spark, sf_dir, "embeddings")
    g = knn_graph(emb, 10, id_col="vec_id", vec_col="embedding", metric="cosine")
    return g.select("src", F.col("rank").cast("bigint").alias("rank"), "dst",
                    F.round("distance", 6).alias("distance"))


@register("neighbour_graph")
def neighbour_graph(spark, sf_dir):
    """JOI-5 at scale: the 10-nearest-neighbour graph by neighbour descent (recall against the exact graph in the tests)."""
    emb = table(spark, sf_dir, "embeddings")
    g = neighbour_descent(emb, 10, id_col="vec_id", vec_col="embedding", metric="cosine")
    return g.select("src", F.col("rank").cast("bigint").alias("rank"), "dst", F.round("distance", 6).alias("distance"))
