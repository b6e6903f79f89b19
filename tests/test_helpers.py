"""Small helpers: column patterns, timestamps, truncation embedding, in-memory texts, params table."""

import pytest
import tempfile

import numpy as np

from quarry.functions.columns import columns_like
from quarry.functions.dates import parse_timestamp, timestamp_string
from quarry.operators.embed import embed_truncated
from quarry.sources.memory import texts_frame, write_search_params


def test_columns_like(spark):
    df = spark.createDataFrame([(1.0, 2.0, "t")], "umap_0 double, umap_1 double, title string")
    assert columns_like(df, "umap_").columns == ["umap_0", "umap_1"]


def test_timestamp_round_trip(spark):
    df = spark.createDataFrame([("2023-11-01 00:00:00+00:00",), ("nope",)], "d string")
    r = df.select(timestamp_string(parse_timestamp("d")).alias("s")).collect()
    assert r[0]["s"] == "2023-11-01 00:00:00" and r[1]["s"] is None


def test_embed_truncated_and_texts(spark):
    df = texts_frame(spark, ["harrison worked at kensho", "Alain worked at Fieldbox " * 3000,
                             "Suzie worked at FamilyMart"])
    out = embed_truncated(df, "text", lambda ts: np.array([[len(t.split(" ")), 1.0] for t in ts]), max_tokens=4096)
    got = {r["id"]: r["vector"] for r in out.collect()}
    assert abs(np.linalg.norm(got[1]) - 1) < 1e-6
    assert got[1][0] / got[1][1] == 4096


def test_params_table(spark):
    d = tempfile.mkdtemp(prefix="quarry-test-")
    write_search_params(spark, {"query": "ai", "sources": ["bbc-news"], "domains": ["apnews.com"],
                                "language": "en", "period": "30d", "override_content": False}, d, "2024-01-01_00-00-00")
    r = spark.read.parquet(d).first()
    assert r["period"] == "30d" and r["sources"] == ["bbc-news"] and r["snapshot_ts"] == "2024-01-01_00-00-00"


def test_embedder_registry_and_benchmark_types(spark):
    from quarry.operators.embedders import get_embedder
    from quarry.operators.pipelines import run_benchmark
    with pytest.raises(ValueError):
        get_embedder("no such embedder")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bad = spark.createDataFrame([("m", "hashed_tfidf", "odd", 8, None)], "model string, model_name string, type string, dim int, "
                                                                         "embed_instruction string")
    with pytest.raises(ValueError):
        run_benchmark(docs, bad, id_col="doc_id", text_col="text")


def test_hashed_terms_of_questions_use_the_fitted_weights(spark):
    from quarry.operators.embed import embed_hashed_terms, fit_hashed_terms
    docs = spark.createDataFrame([(1, "cat dog"), (2, "cat CAT"), (3, None), (4, "--")], "id long, text string")
    idf = fit_hashed_terms(docs, "id", "text", 64)
    v = {r["id"]: r["vector"] for r in embed_hashed_terms(docs, "id", "text", idf, 64).collect()}
    assert sum(v[3]) == sum(v[4]) == 0 and abs(sum(x * x for x in v[1]) - 1) < 1e-6
    q = spark.createDataFrame([(9, "Cat, dog!")], "id long, text string")
    assert embed_hashed_terms(q, "id", "text", idf, 64).first()["vector"] == v[1]


def test_run_csvs_replace_their_run_only(spark):
    from quarry.session import scratch_path
    from quarry.sources.sinks import write_run_csvs
    path = scratch_path(spark, "csv")
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "model string, x int")
    for run in ("r1", "r2", "r1"):
        write_run_csvs(df, path, run)
    got = spark.read.option("header", True).csv(path)
    assert got.count() == 6 and {r["run_ts"] for r in got.collect()} == {"r1", "r2"}
    whole = scratch_path(spark, "csv")
    for _ in range(2):
        write_run_csvs(df, whole, "r1", None)
    assert spark.read.option("header", True).csv(whole).count() == 3


def test_index_pages_of_known_text(spark):
    from quarry.operators.rag import index_pages
    from quarry.session import scratch_path
    page = "<html><title>T {i}</title><body><nav>menu</nav><article><p>Every page says this.</p><p>Only page {i} &amp; no other." \
           "</p></article><footer>foot</footer></body></html>"
    rows = [(i, f"http://h/p{i}", page.replace("{i}", str(i))) for i in range(4)] + [(9, "http://h/9", "<html></html>"), (10, None, None)]
    t = index_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), scratch_path(spark, "index"), dim=32)
    assert {(r["id"], r["text"]) for r in t.collect()} == {(f"{i}_split-0", f"Only page {i} & no other.") for i in range(4)}
    assert t.first()["host"] == "h" and len(t.first()["vector"]) == 32


def test_scratch_folder_is_the_sessions(spark):
    from quarry.session import cut_lineage, drop_lineage, ensure_checkpoint_dir
    df = cut_lineage(spark.range(3).toDF("x"))
    assert df._quarry_path.startswith(ensure_checkpoint_dir(spark).rstrip("/")) and df.count() == 3
    drop_lineage(df)
    import pytest as pt
    with pt.raises(Exception):
        spark.read.parquet(df._quarry_path)
