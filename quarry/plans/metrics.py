"""Clustering-score queries over ``embeddings``: two signed sums of all components are the 2-D
coordinates (orthogonal Walsh rows, a linear projection that SQL can repeat), ``label`` is the cluster
(FIXTURES §2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.vectors import as_double
from quarry.operators import metrics as M
from quarry.plans.registry import register
from quarry.session import table

# "Models" of the score matrix: which two Walsh rows give the coordinates.
SCORE_MODELS = {"c01": (21, 42), "c23": (7, 56), "c45": (27, 45)}
X_ROW, Y_ROW = SCORE_MODELS["c01"]


def walsh(vec, row: int):
    """Signed sum of all components over the root of their number: the sign of component i is the parity of the
    bits that i and ``row`` share."""
    signed = F.transform(as_double(vec), lambda v, i: F.when(F.bit_count(i.bitwiseAND(F.lit(row))) % 2 == 0, v).otherwise(-v))
    return F.aggregate(signed, F.lit(0.0), lambda acc, v: acc + v) / F.sqrt(F.size(vec))


def walsh_sql(row: int, vec: str = "embedding") -> str:
    return (f"(list_sum(list_transform(CAST({vec} AS DOUBLE[]), lambda v, i: CASE WHEN bit_count((i - 1) & {row}) % 2 = 0 "
            f"THEN v ELSE -v END)) / sqrt(len({vec})))")


XY_SQL = f"SELECT vec_id AS id, {walsh_sql(X_ROW)} AS x, {walsh_sql(Y_ROW)} AS y, label FROM embeddings"


def points(spark, sf_dir, i=X_ROW, j=Y_ROW):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), walsh("embedding", i).alias("x"), walsh("embedding", j).alias("y"), "label")


def model_points(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    parts = [e.select(F.lit(m).alias("model"), F.col("vec_id").alias("id"), walsh("embedding", i).alias("x"),
                      walsh("embedding", j).alias("y"), "label")
             for m, (i, j) in SCORE_MODELS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---- SQL oracle text -------------------------------------------------------

def _pts_sql(grouped: bool) -> str:
    if not grouped:
        return f"SELECT 0 AS g, * FROM ({XY_SQL})"
    return " UNION ALL ".join(
        f"SELECT '{m}' AS g, vec_id AS id, {walsh_sql(i)} AS x, {walsh_sql(j)} AS y, label FROM embeddings"
        for m, (i, j) in SCORE_MODELS.items())


def _err_sql(k, n):
    return (f"CASE WHEN {k} < 2 OR {k} > {n} - 1 THEN printf('number of labels is %d; valid values "
            f"are 2 to n_samples - 1 (%d)', {k}, {n} - 1) END")


def _bins_sql(v):
    return " + ".join(
        f"CASE WHEN {v} >= lo{v} + CAST({t} AS DOUBLE) * (hi{v} - lo{v}) / 10.0 THEN 1 ELSE 0 END"
        for t in range(1, 10))


def entropy_ctes() -> str:
    return f"""
st AS (SELECT g, min(x) mnx, max(x) mxx, min(y) mny, max(y) mxy FROM pts GROUP BY g),
eg AS (SELECT p.g, x, y,
         CASE WHEN mxx > mnx THEN mnx ELSE mnx - 0.5 END lox, CASE WHEN mxx > mnx THEN mxx ELSE mxx + 0.5 END hix,
         CASE WHEN mxy > mny THEN mny ELSE mny - 0.5 END loy, CASE WHEN mxy > mny THEN mxy ELSE mxy + 0.5 END hiy
       FROM pts p JOIN st USING (g)),
cells AS (SELECT g, {_bins_sql('x')} AS bx, {_bins_sql('y')} AS by_, FROM eg),
cc AS (SELECT g, bx, by_, count(*) AS cnt FROM cells GROUP BY ALL),
ent AS (SELECT g, -sum((cnt / n) * log2(cnt / n)) AS entropy, count(*) AS n_bins, CAST(max(n) AS BIGINT) AS n
        FROM (SELECT *, sum(cnt) OVER (PARTITION BY g) AS n FROM cc) GROUP BY g)"""


def ch_ctes() -> str:
    return f"""
cen AS (SELECT g, label, count(*) nc, avg(x) cx, avg(y) cy FROM pts GROUP BY g, label),
mu AS (SELECT g, count(*) n, avg(x) mx, avg(y) my FROM pts GROUP BY g),
kk AS (SELECT g, count(*) k FROM cen GROUP BY g),
bb AS (SELECT c.g, sum(nc * ((cx - mx) ^ 2 + (cy - my) ^ 2)) b FROM cen c JOIN mu USING (g) GROUP BY c.g),
ww AS (SELECT p.g, sum((x - cx) ^ 2 + (y - cy) ^ 2) w FROM pts p JOIN cen USING (g, label) GROUP BY p.g),
ch AS (SELECT g, CASE WHEN k < 2 OR k > n - 1 THEN NULL WHEN w = 0 THEN 1.0
                      ELSE (b / (k - 1)) / (w / (n - k)) END AS score, {_err_sql('k', 'n')} AS error
       FROM mu JOIN kk USING (g) JOIN bb USING (g) JOIN ww USING (g))"""


def db_ctes() -> str:
    return f"""
dcen AS (SELECT g, label, avg(x) cx, avg(y) cy FROM pts GROUP BY g, label),
spr AS (SELECT p.g, p.label, avg(sqrt((x - cx) ^ 2 + (y - cy) ^ 2)) s FROM pts p JOIN dcen USING (g, label) GROUP BY ALL),
cs AS (SELECT * FROM dcen JOIN spr USING (g, label)),
rr AS (SELECT a.g, a.label, max(CASE WHEN sqrt((a.cx - b.cx) ^ 2 + (a.cy - b.cy) ^ 2) = 0 THEN 0
                                 ELSE (a.s + b.s) / sqrt((a.cx - b.cx) ^ 2 + (a.cy - b.cy) ^ 2) END) r
       FROM cs a JOIN cs b ON a.g = b.g AND a.label <> b.label GROUP BY ALL),
dn AS (SELECT g, count(*) n FROM pts GROUP BY g),
dbi AS (SELECT g, CASE WHEN k < 2 OR k > n - 1 THEN NULL ELSE avg_r END AS score, {_err_sql('k', 'n')} AS error
        FROM (SELECT g, count(*) k, avg(r) avg_r FROM rr GROUP BY g) JOIN dn USING (g))"""


def sil_ctes() -> str:
    return f"""
pr AS (SELECT a.g, a.id, a.label, b.label AS c, sum(sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2)) s, count(*) nn
       FROM pts a JOIN pts b ON a.g = b.g GROUP BY ALL),
pp AS (SELECT g, id, label,
         max(CASE WHEN c = label AND nn > 1 THEN s / (nn - 1) END) a,
         max(CASE WHEN c = label THEN nn END) own_n,
         min(CASE WHEN c <> label THEN s / nn END) b
       FROM pr GROUP BY ALL),
sn AS (SELECT g, count(DISTINCT label) k FROM pts GROUP BY g),
sil AS (SELECT g, CASE WHEN k < 2 OR k > n - 1 THEN NULL ELSE sv END AS score, {_err_sql('k', 'n')} AS error
        FROM (SELECT g, avg(coalesce(CASE WHEN own_n <= 1 THEN 0.0 ELSE (b - a) / greatest(a, b) END, 0.0)) sv,
                     count(*) n FROM pp GROUP BY g) JOIN sn USING (g))"""


def _single(ctes: str, name: str) -> str:
    return f"WITH pts AS ({_pts_sql(False)}),{ctes}\nSELECT round(score, 6) AS score, error FROM {name}"


# ---- queries ---------------------------------------------------------------

@register("minmax_scaled", sql=f"""
WITH pts AS ({_pts_sql(False)}),
st AS (SELECT min(x) mnx, max(x) mxx, min(y) mny, max(y) mxy FROM pts)
SELECT id, label, round(x, 6) AS x, round(y, 6) AS y,
       round(CASE WHEN mxx > mnx THEN (x - mnx) / (mxx - mnx) END, 6) AS x_scaled,
       round(CASE WHEN mxy > mny THEN (y - mny) / (mxy - mny) END, 6) AS y_scaled
FROM pts, st""")
def q_minmax_scaled(spark, sf_dir):
    """AGG-2 / JOI-9 / FN-14 / PROJ-3."""
    s = M.minmax_scaled(points(spark, sf_dir), ["x", "y"])
    return s.select("id", "label", *[F.round(c, 6).alias(c) for c in ["x", "y", "x_scaled", "y_scaled"]])


@register("joint_entropy", sql=f"""
WITH pts AS ({_pts_sql(False)}),{entropy_ctes()}
SELECT round(entropy, 6) AS entropy, n_bins, n FROM ent""")
def q_joint_entropy(spark, sf_dir):
    """AGG-3 / FN-15: 10 bins per dimension, bits."""
    e = M.joint_entropy(points(spark, sf_dir), ["x", "y"])
    return e.select(F.round("entropy", 6).alias("entropy"), "n_bins", "n")


@register("calinski_harabasz", sql=_single(ch_ctes(), "ch"))
def q_calinski_harabasz(spark, sf_dir):
    """AGG-4."""
    r = M.calinski_harabasz(points(spark, sf_dir), ["x", "y"], "label")
    return r.select(F.round("score", 6).alias("score"), "error")


@register("davies_bouldin", sql=_single(db_ctes(), "dbi"))
def q_davies_bouldin(spark, sf_dir):
    """AGG-6."""
    r = M.davies_bouldin(points(spark, sf_dir), ["x", "y"], "label")
    return r.select(F.round("score", 6).alias("score"), "error")


@register("silhouette", sql=_single(sil_ctes(), "sil"))
def q_silhouette(spark, sf_dir):
    """AGG-5 / JOI-8: exact Euclidean silhouette over all points."""
    r = M.silhouette(points(spark, sf_dir), ["x", "y"], "label", "id")
    return r.select(F.round("score", 6).alias("score"), "error")


@register("silhouette_sq", sql=f"""
WITH pts AS ({_pts_sql(False)}),
mom AS (SELECT label AS c, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x + y * y) AS ss FROM pts GROUP BY label),
d AS (SELECT id, label, c, n, greatest(x * x + y * y - 2 * (x * sx + y * sy) / n + ss / n, 0) AS m FROM pts, mom),
p AS (SELECT id, label, max(CASE WHEN c = label THEN n END) AS n, max(CASE WHEN c = label THEN m * n / greatest(n - 1, 1) END) AS a,
             min(CASE WHEN c <> label THEN m END) AS b FROM d GROUP BY id, label),
g AS (SELECT avg(CASE WHEN n <= 1 OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END) AS score,
             count(*) AS n, count(DISTINCT label) AS k FROM p)
SELECT CASE WHEN k < 2 OR k > n - 1 THEN NULL ELSE round(score, 6) END AS score, {_err_sql('k', 'n')} AS error FROM g""")
def q_silhouette_sq(spark, sf_dir):
    """AGG-5 with squared distances, from cluster moments."""
    r = M.silhouette_sq(points(spark, sf_dir), ["x", "y"], "label")
    return r.select(F.round("score", 6).alias("score"), "error")


@register("score_matrix", sql=f"""
WITH pts AS ({_pts_sql(True)}),{entropy_ctes()},{ch_ctes()},{db_ctes()},{sil_ctes()}
SELECT g AS model, round(ch.score, 6) AS calinski_harabasz, round(sil.score, 6) AS silhouette,
       round(dbi.score, 6) AS davies_bouldin, round(ent.entropy, 6) AS entropy
FROM ch JOIN sil USING (g) JOIN dbi USING (g) JOIN ent USING (g)""")
def q_score_matrix(spark, sf_dir):
    """AGG-8: model × metric matrix; every model is scored in the same jobs (group key first)."""
    p = model_points(spark, sf_dir)
    by = ["model"]
    longs = [
        M.calinski_harabasz(p, ["x", "y"], "label", by).select("model", F.lit("calinski_harabasz").alias("metric"), F.col("score").alias("value")),
        M.silhouette(p, ["x", "y"], "label", "id", by).select("model", F.lit("silhouette").alias("metric"), F.col("score").alias("value")),
        M.davies_bouldin(p, ["x", "y"], "label", by).select("model", F.lit("davies_bouldin").alias("metric"), F.col("score").alias("value")),
        M.joint_entropy(p, ["x", "y"], by).select("model", F.lit("entropy").alias("metric"), F.col("entropy").alias("value")),
    ]
    long = longs[0]
    for x in longs[1:]:
        long = long.unionByName(x)
    metrics = ["calinski_harabasz", "silhouette", "davies_bouldin", "entropy"]
    wide = long.groupBy("model").pivot("metric", metrics).agg(F.first("value"))
    return wide.select("model", *[F.round(m, 6).alias(m) for m in metrics])
