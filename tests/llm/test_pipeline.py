"""The pipeline against a plain version of each stage, and its contract."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from quarry.llm import mixing, quality, toxicity
from quarry.llm.labelled import fold
from quarry.session import cut_lineage

from .test_pair_ops import _brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, f in P.STAGES:
        out.append(cut_lineage(f(spark, out[-1], SF)))
    return out


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in P.STAGES] == ["toxicity", "quality", "near_duplicates", "mixing", "encode"]
    for d in stages[1:-1]:
        assert d.dtypes == stages[0].dtypes


def test_classifier_stages_drop_what_they_reject(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for docs, kept, module, keep, name in [
            (stages[0], stages[1], toxicity, fold("doc_id", 3) != 1, "toxic"), (stages[1], stages[2], quality, fold("doc_id", 5) != 0, "quality")]:
        model = module.fit(docs.select("doc_id", "text"), labels, keep)
        rows = docs.collect()
        if name == "toxic":
            want = [r["doc_id"] for r in rows if model.score(r["text"])[0] < 0.7]
        else:
            import numpy as np
            p = model.predict(np.array([quality.statistics(r["text"]) for r in rows]))
            want = [r["doc_id"] for r, s in zip(rows, p) if s >= 0.3]
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)


def test_one_of_each_group_of_near_copies_stays(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    want = [d for d, n, c in _brute(rows) if not n or d == c]
    assert sorted(r["doc_id"] for r in stages[3].collect()) == sorted(want)


def test_mixing_takes_whole_documents_towards_the_targets(spark, stages):
    docs = stages[3]
    sized = docs.select("doc_id", "source", mixing.seeded_hash(F.col("doc_id"), P.MIX_SEED).alias("u"),
                        mixing.word_count("text").alias("size"), F.array("source").alias("sources"))
    times = {r["doc_id"]: r["times"] for r in mixing.apply_mix(sized, mixing.plan_mix(sized)).collect()}
    got = Counter(r["doc_id"] for r in stages[4].collect())
    assert got == Counter({d: t for d, t in times.items() if t}) and max(got.values()) <= 3


def test_encoding_covers_every_row(stages):
    assert stages[5].count() == stages[4].count() and stages[5].where("NOT round_trip").count() == 0


def test_run_is_the_chain_of_stages(spark, stages):
    key = lambda d: Counter((r["doc_id"], tuple(r["ids"])) for r in d.collect())
    assert key(P.run(spark, SF)) == key(stages[5])


def test_stages_take_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c d e f", "en", None, 11),
                                  (3, "a b c d e f", "en", "s", 11), (3, "a b c d e f", "en", "s", 11), (4, "x y", None, "s", 3)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    for d in (docs, docs.limit(0)):
        for name, f in P.STAGES:
            d = cut_lineage(f(spark, d, SF))
        assert d.count() <= 9


def test_near_duplicates_keep_one_of_equal_rows(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "other words that stand quite alone here"), (3, "a b c d e f"), (5, "q r"), (5, "q r"),
            (6, None), (6, None), (None, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, P.drop_near_duplicates(spark, docs, SF).collect()), key=str)
    assert got == sorted([(1, "a b c d e f"), (2, "a b c d e f"), (2, "other words that stand quite alone here"), (5, "q r"),
                          (6, None), (6, None), (None, "a b c d e f")], key=str)
