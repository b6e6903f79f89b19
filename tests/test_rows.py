"""No row is lost, doubled or mixed up: repeated ids, null ids and coordinates, text keys, batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import cluster as K
from quarry.operators import metrics as M


def test_extract_keeps_rows_with_repeated_and_null_ids(spark):
    from quarry.operators.extract import extract_articles
    page = "<html><body><article><p>{}</p><p>{}</p></article></body></html>"
    rows = [(1, "http://h/a", page.format("one", "uno")), (1, "http://h/b", page.format("two", "dos")), (None, "http://h/c", page.format("three", "tres"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for least in (3, None):
        got = {r["url"]: r["full_text"] for r in extract_articles(df, min_pages=least).collect()}
        assert got == {"http://h/a": "one\n\nuno", "http://h/b": "two\n\ndos", "http://h/c": "three\n\ntres"}


def test_dbscan_returns_points_without_coordinates_as_noise(spark):
    rows = [(i, 0.01 * i, 0.0, 0) for i in range(20)] + [(20, None, 0.0, 0), (21, float("nan"), 0.0, 0)]
    df = spark.createDataFrame(rows, "id long, x double, y double, k long")
    got = {r["id"]: r["cluster"] for r in K.dbscan(df, id_col="id", x="x", y="y", eps=0.05, min_samples=3).collect()}
    assert len(got) == 22 and got[20] == got[21] == -1 and set(got[i] for i in range(20)) == {0}
    text = df.withColumn("id", F.concat(F.lit("p"), "id"))
    named = {r["id"]: r["cluster"] for r in K.dbscan(text, id_col="id", x="x", y="y", eps=0.05, min_samples=3).collect()}
    assert named["p20"] == "-1" and named["p3"] == "p0"
    grid = df.withColumn("eps", F.lit(0.05)).withColumn("m", F.lit(3))
    assert K.dbscan(grid, id_col="id", x="x", y="y", eps="eps", min_samples="m", config_col="k").count() == 22


def test_embeddings_are_per_row(spark):
    from quarry.operators.embed import embed_hashed_terms, fit_hashed_terms
    from quarry.operators.rag import index_texts
    df = spark.createDataFrame([(1, "red fox"), (1, "blue owl"), (2, "red owl"), (None, None), (3, "")], "id long, text string")
    v = embed_hashed_terms(df, "id", "text", fit_hashed_terms(df, "id", "text", 64), 64).collect()
    assert len(v) == 5 and len({tuple(r["vector"]) for r in v if r["id"] == 1}) == 2
    assert all(not any(r["vector"]) for r in v if r["id"] in (None, 3))
    assert index_texts(df, "id", "text", dim=64).count() == 3
    assert index_texts(df, "id", "text", dim=64, mode="none", vector_scope="document").count() == 5


def test_lloyd_step_counts_rows_and_skips_null_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (1, [0.2, 0.0]), (2, [4.0, 4.0]), (3, None)], "id long, v array<double>")
    c = spark.createDataFrame([(0, [0.0, 0.0]), (1, [5.0, 5.0])], "cid long, v array<double>")
    got = {r["cluster"]: r for r in K.lloyd_step(df, c, id_col="id", vec_col="v", cid_col="cid").collect()}
    assert got[0]["n"] == 2 and got[1]["n"] == 1 and len(got) == 2 and np.allclose(got[0]["centroid"], [0.1, 0.0])
    a = K.assign_to_centroids(df, c, id_col="id", vec_col="v", cid_col="cid").collect()
    assert len(a) == 4 and [tuple(r) for r in a if r["id"] == 3] == [(3, None, None)]


def test_centroids_reach_the_tasks_in_batches(spark):
    rng = np.random.default_rng(0)
    pts, cents = rng.normal(size=(200, 5)).round(1), rng.normal(size=(40, 5)).round(1)
    cents[30] = cents[3]                                           # ties go to the smaller id
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(pts)], "id long, v array<double>")
    c = spark.createDataFrame([(f"c{i:02d}", v.tolist()) for i, v in enumerate(cents)], "cid string, v array<double>")
    d = ((pts[:, None, :] - cents[None, :, :]) ** 2).sum(-1)
    for size in (64 << 20, 500):
        got = {r["id"]: r for r in K.assign_to_centroids(df, c, id_col="id", vec_col="v", cid_col="cid", max_bytes=size).collect()}
        assert all(got[i]["cluster"] == f"c{d[i].argmin():02d}" and np.isclose(got[i]["distance"], d[i].min()) for i in range(200))


def test_kmeans_seeds_and_fixed_point(spark):
    rng = np.random.default_rng(1)
    pts = np.vstack([rng.normal(c, 0.1, (30, 3)) for c in (0, 5, 10)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(pts)] + [(500, None)], "id long, v array<double>")
    lab, cents = K.kmeans_fixed_point(df, 3, id_col="id", vec_col="v")
    got = {r["id"]: r["cluster"] for r in lab.collect()}
    assert got[500] is None and sorted(len({got[i] for i in range(a, a + 30)}) for a in (0, 30, 60)) == [1, 1, 1]
    again, _ = K.kmeans_fixed_point(df.repartition(7), 3, id_col="id", vec_col="v")
    assert {r["id"]: r["cluster"] for r in again.collect()} == got
    same = spark.createDataFrame([(i, [1.0]) for i in range(5)], "id long, v array<double>")
    assert K.kmeans_seeds(same, 3, id_col="id", vec_col="v").count() == 1
    assert K.kmeans_fixed_point(same.where("false"), 3, id_col="id", vec_col="v")[0].count() == 0


def test_json_envelopes_keep_the_last_row_of_a_key_and_null_keys(spark, tmp_path):
    from quarry.sources.corpus_json import read_corpus_json, write_corpus_json
    rows = [("a", "t1"), ("a", "t2"), (None, "t3"), ("b", "t4")]
    df = spark.createDataFrame([(i, t, t, None, "c") for i, t in rows], "id string, title string, abstract string, date string, category string").coalesce(1)
    write_corpus_json(df, str(tmp_path / "j"), ["q"], "2024")
    got = {r["id"]: r["title"] for r in read_corpus_json(spark, str(tmp_path / "j")).collect()}
    assert got == {"a": "t2", "null": "t3", "b": "t4"}


def test_prompt_of_a_null_text_is_empty(spark):
    from quarry.operators.summarize import prompt_docs
    df = spark.createDataFrame([(1, None), (2, "x")], "id long, text string")
    assert {r["id"]: r["page_content"] for r in prompt_docs(df, "id", "text", ["id"]).collect()} == {1: "Article n°1 -- ", 2: "Article n°2 -- x"}


def test_streams_have_no_limit_unless_the_caller_sets_one():
    import inspect
    from quarry.streaming.corpus_stream import run_available_now
    assert inspect.signature(run_available_now).parameters["timeout_s"].default is None


def test_silhouette_sq_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    pts = np.vstack([rng.normal(c, 0.5, (n, 3)) for c, n in ((0, 20), (2, 15), (5, 1))])
    lab = [0] * 20 + [1] * 15 + [2]
    rows = [(g, *map(float, p), x) for g in ("a", None) for p, x in zip(pts if g else pts[::-1], lab)]
    df = spark.createDataFrame(rows, "g string, x double, y double, z double, label int")
    for g, p in (("a", pts), (None, pts[::-1])):
        d = ((p[:, None, :] - p[None, :, :]) ** 2).sum(-1)
        s = []
        for i, x in enumerate(lab):
            mean = {c: d[i][[j for j, y in enumerate(lab) if y == c and j != i]].mean() for c in set(lab) if [j for j, y in enumerate(lab) if y == c and j != i]}
            s.append(0.0 if lab.count(x) == 1 else (min(v for c, v in mean.items() if c != x) - mean[x]) / max(mean[x], min(v for c, v in mean.items() if c != x)))
        for batch in (4096, 2):
            got = [r["score"] for r in M.silhouette_sq(df, ["x", "y", "z"], "label", ["g"], batch=batch).collect() if r["g"] == g]
            assert np.allclose(got, [np.mean(s)])
    one = M.silhouette_sq(df.where("label = 0"), ["x", "y", "z"], "label").first()
    assert one["score"] is None and "number of labels is 1" in one["error"]


def test_clustering_pipeline_attaches_metadata_one_to_one(spark):
    from quarry.operators.pipelines import clustering_pipeline
    emb = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding")
    data = emb.select("vec_id", F.lit("t").alias("title"))
    out = clustering_pipeline(emb, {"n_neighbors": 5, "n_epochs": 3}, {"min_cluster_size": 5, "min_samples": 3}, id_col="vec_id", vec_col="embedding", data=data)
    assert out.columns == ["vec_id", "umap_0", "umap_1", "cluster", "noise", "title"] and out.count() == emb.count()
    plain = clustering_pipeline(emb, {"n_neighbors": 5, "n_epochs": 3}, None, id_col="vec_id", vec_col="embedding")
    assert plain.columns == ["vec_id", "umap_0", "umap_1"]
    with pytest.raises(ValueError):
        clustering_pipeline(emb, {"n_neighbors": 5, "n_epochs": 3}, None, id_col="vec_id", vec_col="embedding", data=data.limit(3))
