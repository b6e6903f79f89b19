"""Hand-made fixtures for the sources (FIXTURES §3); written to fresh temp folders."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from quarry.operators import relational as R
from quarry.sources.atom import read_atom
from quarry.sources.corpus_json import read_corpus_json
from quarry.sources.search import read_search_pages


def test_corpus_envelope_multiline(spark):
    d = tempfile.mkdtemp(prefix="quarry-test-")
    env = {"queries": ["ti:deep", "abs:graph"],
           "results": {"http://x/1": {"title": "Économie", "abstract": "a", "date": "2023-11-01 00:00:00+00:00",
                                      "category": "cs.LG"},
                       "http://x/2": {"title": "b", "abstract": "b", "date": "2023-11-02 10:00:00+00:00",
                                      "category": "cs.CL"},
                       "http://x/3": {"title": "c", "abstract": "c", "date": None, "category": "cs.AI"}}}
    with open(os.path.join(d, "corpus.json"), "w", encoding="utf-8") as fh:
        json.dump(env, fh, ensure_ascii=False, indent=2)
    rows = {r["id"]: r for r in read_corpus_json(spark, d, multi_line=True).collect()}
    assert set(rows) == {"http://x/1", "http://x/2", "http://x/3"}
    assert rows["http://x/1"]["title"] == "Économie"
    assert rows["http://x/1"]["published_at"] is not None


def test_keyed_union_last_wins(spark):
    a = spark.createDataFrame([(0, "id1", "old title"), (0, "id2", "t2")], "query_idx int, id string, title string")
    b = spark.createDataFrame([(1, "id1", "new title")], "query_idx int, id string, title string")
    k = {r["id"]: r for r in R.keep_last(R.union_all(a, b), ["id"], ["query_idx"]).collect()}
    assert k["id1"]["title"] == "new title" and k["id1"]["first_query_idx"] == 0


def test_atom_numeric_id_stays_string(spark):
    d = tempfile.mkdtemp(prefix="quarry-test-")
    xml = ("<feed>" + "".join(f"<entry><id>{i}</id><title>T{i}</title><summary>S {i}</summary>"
                              f"<published>2024-01-0{i}</published><author>a</author><category>c</category></entry>"
                              for i in (1, 2, 3)) + "</feed>")
    with open(os.path.join(d, "feed.xml"), "w") as fh:
        fh.write(xml)
    df = read_atom(spark, d)
    assert dict(df.dtypes)["id"] == "string"
    assert sorted(r["id"] for r in df.collect()) == ["1", "2", "3"]


def _write_pages(d, total, n_pages, size=20, dup_url=None):
    for p in range(1, n_pages + 1):
        pd_ = os.path.join(d, "query_idx=0", f"page={p}")
        os.makedirs(pd_)
        with open(os.path.join(pd_, "part-0.json"), "w") as fh:
            for i in range(size):
                pos = (p - 1) * size + i + 1
                if pos > total:
                    break
                url = dup_url if (dup_url and pos in (3, 25)) else f"http://n/{pos}"
                fh.write(json.dumps({"query": "q", "pos": pos, "total_results": total, "id": url, "url": url,
                                     "title": f"t{pos}", "source": "s", "lang": "en" if pos % 2 else "fr",
                                     "published_at": f"2024-01-{1 + pos % 28:02d}"}) + "\n")


def test_paging_rule_and_dedup(spark):
    d = tempfile.mkdtemp(prefix="quarry-test-")
    _write_pages(d, 47, 3, dup_url="http://n/dup")
    rows = read_search_pages(spark, d)
    assert rows.count() == 47
    assert rows.select("id").distinct().count() == 46
    d2 = tempfile.mkdtemp(prefix="quarry-test-")
    _write_pages(d2, 250, 13)
    r2 = read_search_pages(spark, f"file://{d2}")
    assert r2.count() == 100 and r2.select(F.max("page")).first()[0] == 5
    assert read_search_pages(spark, d2, max_results=10).count() == 20       # the first page is always fetched


def test_search_filters(spark):
    d = tempfile.mkdtemp(prefix="quarry-test-")
    _write_pages(d, 47, 3)
    assert read_search_pages(spark, d, language="en").count() == 24
    assert read_search_pages(spark, d, country="fr").count() == 0
    assert read_search_pages(spark, d, queries=[1]).count() == 0
    days = [r["published_at"] for r in read_search_pages(spark, d).collect()]
    got = read_search_pages(spark, d, from_date="2024-01-10", to_date="2024-01-12")
    both = got.where((F.col("published_at") >= "2024-01-11") & (F.col("published_at") >= "2024-01-05"))
    assert got.count() == sum("2024-01-10" <= x <= "2024-01-12" for x in days)
    assert both.count() == sum("2024-01-11" <= x <= "2024-01-12" for x in days)
