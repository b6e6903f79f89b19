"""Every registered query runs on sf0.001 with a stable schema; entry() works."""

import pytest

import __spark_entry__ as E
from quarry.plans import ORACLES, QUERIES


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() == 40 and df.columns == ["label", "rank", "vec_id", "distance"]


def test_every_query_has_an_oracle_or_is_known_rows_only():
    rows_only = set(QUERIES) - set(ORACLES)
    assert rows_only <= {"index_pages", "rag_answer", "umap_2d", "clustering_pipeline", "fuzzy_membership",
                         "projection_grid", "benchmark_scores", "hdbscan_labels", "hdbscan_grid", "neighbour_graph"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs_smoke(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    df.collect()
