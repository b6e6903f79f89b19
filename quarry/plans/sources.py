"""Source/sink round trips over the driver tables (phase 8).

Written artifacts go to fresh folders under ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.operators import relational as R
from quarry.operators.predicates import term
from quarry.plans.registry import register
from quarry.session import ensure_checkpoint_dir, table
from quarry.sources.atom import read_atom, write_atom
from quarry.sources.corpus_json import read_corpus_json, write_corpus_json
from quarry.sources.search import paged_search


def _scratch(spark, name):
    return ensure_checkpoint_dir(spark).rstrip("/") + f"/quarry-artifacts/{name}-{uuid.uuid4().hex[:12]}"


def _records(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("id"),
                    F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("abstract"),
                    F.lit(None).cast("string").alias("date"), F.col("lang").alias("category"))


@register("json_roundtrip", sql="""
SELECT CAST(doc_id AS VARCHAR) AS id, md5(split_part(text, chr(10), 1)) AS title_md5, md5(text) AS abstract_md5,
       lang AS category, CAST(NULL AS TIMESTAMP) AS published_at, '2024-01-31_00-00-00' AS snapshot_ts
FROM documents""")
def q_json_roundtrip(spark, sf_dir):
    """SNK-1 → SRC-1: corpus written as JSON envelopes (bounded buckets, snapshot
    partition) and read back by exploding the ``results`` map."""
    path = _scratch(spark, "corpus_json")
    write_corpus_json(_records(spark, sf_dir), path, ["all:documents"], "2024-01-31_00-00-00")
    r = read_corpus_json(spark, path, keep_snapshot=True)
    return r.select("id", F.md5("title").alias("title_md5"), F.md5("abstract").alias("abstract_md5"),
                    "category", F.col("published_at").cast("timestamp_ntz").alias("published_at"),
                    F.col("snapshot_ts").cast("string").alias("snapshot_ts"))


@register("atom_scan", sql="""
SELECT CAST(doc_id AS VARCHAR) AS id, md5(split_part(text, chr(10), 1)) AS title_md5, md5(text) AS summary_md5,
       source AS author, lang AS category FROM documents""")
def q_atom_scan(spark, sf_dir):
    """SRC-3: entries written as an Atom-like XML feed and scanned with an explicit
    schema (``id`` stays a string)."""
    d = table(spark, sf_dir, "documents")
    e = d.select(F.col("doc_id").cast("string").alias("id"), F.substring_index("text", "\n", 1).alias("title"),
                 F.col("text").alias("summary"), F.lit(None).cast("string").alias("published"),
                 F.col("source").alias("author"), F.col("lang").alias("category"))
    path = _scratch(spark, "atom")
    write_atom(e, path)
    r = read_atom(spark, path)
    return r.select("id", F.md5("title").alias("title_md5"), F.md5("summary").alias("summary_md5"),
                    "author", "category")


SEARCHES = {"the": term("all", "the"), "and": term("all", "and")}


@register("search_replay", sql="""
WITH t AS (SELECT doc_id, lang, string_split(lower(regexp_replace(text, '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ') AS ta
           FROM documents),
h AS (SELECT 0 AS query_idx, doc_id, lang FROM t WHERE list_contains(ta, 'the')
      UNION ALL SELECT 1, doc_id, lang FROM t WHERE list_contains(ta, 'and')),
r AS (SELECT *, row_number() OVER (PARTITION BY query_idx ORDER BY doc_id DESC) AS pos FROM h),
p AS (SELECT *, CAST(ceil(pos / 20) AS INTEGER) AS page FROM r WHERE pos <= 100 AND lang = 'en')
SELECT CAST(doc_id AS VARCHAR) AS id, max(query_idx) AS query_idx, arg_max(page, query_idx) AS page,
       CAST(arg_max(pos, query_idx) AS INTEGER) AS pos, min(query_idx) AS first_query_idx FROM p GROUP BY doc_id""")
def q_search_replay(spark, sf_dir):
    """SRC-2/4/7 + LIM-2 + SET-2: two searches, newest first, at most 100 matches each in pages of 20, their English
    articles keyed by id (last query wins)."""
    d = table(spark, sf_dir, "documents")
    rows = paged_search(d, {"abstract": F.col("text")}, SEARCHES, "doc_id", "doc_id", keep=("lang",)).where("lang = 'en'")
    k = R.keep_last(rows.select(F.col("id").cast("string").alias("id"), "query_idx", "page", "pos"), ["id"], ["query_idx"])
    return k.select("id", "query_idx", "page", "pos", F.col("first_query_idx"))
