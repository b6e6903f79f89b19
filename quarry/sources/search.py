"""Paged search (SRC-2, SRC-4, SRC-7, LIM-2, SET-1).

``paged_search`` answers named searches over an article table in one scan: the ``max_results`` newest matches of
each (a ranked window that Spark limits before the exchange), with their page and the search's total.

``read_search_pages`` reads pages that a search API returned, landed as NDJSON in folders
``query_idx=…/page=…``, through Spark's own JSON source: any store that Spark reads, partition pruning on query
and page, and every predicate the caller adds.  The paging rule is a column expression: the first page is always
read; page p is read while ``p * size <= max_results``, up to the last page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators.predicates import keyword_search

SCHEMA = ("query_idx int, query string, page int, pos int, total_results long, id string, url string, "
          "title string, source string, lang string, country string, published_at string")


def paged_search(articles: DataFrame, fields: dict, queries: dict, id_col: str, order_col: str, *, page_size: int = 20,
                 max_results: int = 100, keep: tuple[str, ...] = (), descending: bool = True) -> DataFrame:
    """``(query_idx, query, page, pos, total_results, id, <keep>)``: matches of each named query ordered by
    ``order_col`` (newest first by default, ties by id), at most ``max_results`` of each."""
    names = list(queries)
    hits = keyword_search(articles, fields, queries, id_col).select("query_id", id_col)
    totals = hits.groupBy("query_id").agg(F.count("*").alias("total_results"))
    cols = [id_col, *[c for c in dict.fromkeys((order_col, *keep)) if c != id_col]]
    order = F.col(order_col).desc_nulls_last() if descending else F.col(order_col).asc_nulls_last()
    w = Window.partitionBy("query_id").orderBy(order, F.col(id_col))
    top = hits.join(articles.select(*cols), id_col).withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= max_results)
    at = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("query_id")) - 1
    return top.join(totals, "query_id").select(
        at.cast("int").alias("query_idx"), F.col("query_id").alias("query"), F.ceil(F.col("pos") / page_size).cast("int").alias("page"),
        "pos", "total_results", F.col(id_col).alias("id"), *keep)


def read_search_pages(spark: SparkSession, path: str, *, page_size: int = 20, max_results: int = 100,
                      queries: list[int] | None = None, language: str | None = None, country: str | None = None,
                      from_date: str | None = None, to_date: str | None = None) -> DataFrame:
    """SRC-4/7: the articles of the pages a caller of the API would have fetched.  Dates are inclusive
    bounds on ``published_at`` (ISO text); filters left out do not apply."""
    rows = spark.read.schema(SCHEMA).json(path)
    last = F.least(F.ceil(F.col("total_results") / page_size), F.lit(max(1, max_results // page_size)))
    keep = F.col("page") <= last
    if queries is not None:
        keep = keep & F.col("query_idx").isin(queries)
    for col, value in (("lang", language), ("country", country)):
        if value is not None:
            keep = keep & (F.col(col) == value)
    if from_date is not None:
        keep = keep & (F.col("published_at") >= from_date)
    if to_date is not None:
        keep = keep & (F.col("published_at") <= to_date)
    return rows.where(keep)
