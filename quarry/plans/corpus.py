"""Relational corpus queries over ``documents``, ``orders``, ``pages``,
``labels``, ``conversations`` and ``embeddings`` (SURVEY phase 2)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import urls as U
from quarry.functions.dates import date_window, period_window
from quarry.functions.text import regex_token_count, truncate_words, ws_token_count
from quarry.operators import relational as R
from quarry.operators.predicates import SORTS, keyword_search, sorted_search, term
from quarry.plans.registry import register
from quarry.session import table

NL = "chr(10)"
SQL_WORD_TOKENS = "string_split(lower(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"
SQL_URI = r"'^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?'"
SQL_HOST = f"lower(regexp_replace(regexp_replace(regexp_extract(url, {SQL_URI}, 4), '^.*@', ''), ':[0-9]*$', ''))"
SQL_TOKEN_COUNT = "len(regexp_extract_all({x}, '\\p{{L}}+|\\p{{N}}+|[^\\s\\p{{L}}\\p{{N}}]'))"

# Named keyword searches of ``keyword_match`` (fixed values).
KEYWORD_QUERIES = {
    "q_the_and": term("all", "the") & term("all", "and"),
    "q_le_or_la": term("all", "le") | term("all", "la"),
    "q_der_not_und": (term("all", "der") | term("all", "die")) & ~term("all", "und"),
    "q_title_el": term("title", "el"),
}


def _doc_fields():
    return {"title": F.substring_index(F.col("text"), "\n", 1), "abstract": F.col("text")}


def _sql_hits(words, fields=("tt", "ta")):
    ws = ", ".join(f"'{w}'" for w in sorted(words))
    return " + ".join(f"len(list_filter({f}, lambda x: x IN ({ws})))" for f in fields)


@register("keyword_match", sql=f"""
WITH t AS (SELECT doc_id, {SQL_WORD_TOKENS.format(x=f"split_part(text, {NL}, 1)")} AS tt,
                  {SQL_WORD_TOKENS.format(x="text")} AS ta FROM documents),
t2 AS (SELECT *, len(list_filter(tt, lambda x: x <> '')) + len(list_filter(ta, lambda x: x <> '')) AS n_tokens FROM t),
m AS (
  SELECT 'q_the_and' AS query_id, doc_id, {_sql_hits(['the', 'and'])} AS hits, n_tokens FROM t2
   WHERE (list_contains(tt, 'the') OR list_contains(ta, 'the')) AND (list_contains(tt, 'and') OR list_contains(ta, 'and'))
  UNION ALL
  SELECT 'q_le_or_la', doc_id, {_sql_hits(['le', 'la'])}, n_tokens FROM t2
   WHERE list_contains(tt, 'le') OR list_contains(ta, 'le') OR list_contains(tt, 'la') OR list_contains(ta, 'la')
  UNION ALL
  SELECT 'q_der_not_und', doc_id, {_sql_hits(['der', 'die'])}, n_tokens FROM t2
   WHERE (list_contains(tt, 'der') OR list_contains(ta, 'der') OR list_contains(tt, 'die') OR list_contains(ta, 'die'))
     AND NOT (list_contains(tt, 'und') OR list_contains(ta, 'und'))
  UNION ALL
  SELECT 'q_title_el', doc_id, {_sql_hits(['el'], ('tt',))}, n_tokens FROM t2 WHERE list_contains(tt, 'el')),
s AS (SELECT *, CASE WHEN n_tokens > 0 THEN hits / n_tokens ELSE 0.0 END AS score FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_id, rank, doc_id, hits, n_tokens, round(score, 6) AS score FROM r WHERE rank <= 100
""")
def q_keyword_match(spark, sf_dir):
    """FIL-1 / SRT-2 / SRT-1: four boolean keyword searches in one scan, best 100 by relevancy."""
    docs = table(spark, sf_dir, "documents")
    r = keyword_search(docs, _doc_fields(), KEYWORD_QUERIES, "doc_id", top_n=100)
    return r.select("query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id",
                    F.col("hits").cast("bigint").alias("hits"),
                    F.col("n_tokens").cast("bigint").alias("n_tokens"),
                    F.round("score", 6).alias("score"))


def filter_articles(df, *, language=None, lang_col="lang", sources=None, source_col="source",
                    domains=None, url_col=None, date_col=None, period=None, as_of=None,
                    start=None, end=None, exclude_websites=None):
    """SRC-4/7 over a landed article table: FIL-2..5 combined.  ``None`` or an
    empty list means "no constraint"; sources and domains combine by OR."""
    cond = F.lit(True)
    if language is not None:
        cond = cond & (F.col(lang_col) == F.lit(language))
    src_c = F.col(source_col).isin(list(sources)) if sources else None
    dom_c = U.host_matches(F.col(url_col), list(domains)) if (domains and url_col) else None
    if src_c is not None and dom_c is not None:
        cond = cond & (src_c | dom_c)
    elif src_c is not None:
        cond = cond & src_c
    elif dom_c is not None:
        cond = cond & dom_c
    if date_col is not None and (period is not None or start is not None or end is not None):
        cond = cond & period_window(date_col, period, as_of, start, end)
    if exclude_websites and url_col:
        cond = cond & ~U.host_matches(F.col(url_col), list(exclude_websites))
    return df.where(cond)


@register("source_lang_filter", sql="""
SELECT doc_id, source, lang, n_chars FROM documents
WHERE lang = 'en' AND source IN ('src1', 'src3', 'src5')""")
def q_source_lang_filter(spark, sf_dir):
    """FIL-2 / FIL-3 / FN-1: language equality and source-list membership."""
    d = table(spark, sf_dir, "documents")
    return filter_articles(d, language="en", sources=["src1", "src3", "src5"]) \
        .select("doc_id", "source", "lang", "n_chars")


_SORT_QUERIES = {"the": term("abstract", "the")}


@register("sorted_search", sql="""
WITH t AS (SELECT doc_id, source, n_chars,
                  string_split(lower(regexp_replace(text, '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ') AS ta FROM documents),
h AS (SELECT doc_id, source, n_chars, len(list_filter(ta, lambda x: x = 'the')) AS hits, len(list_filter(ta, lambda x: x <> '')) AS n
      FROM t WHERE list_contains(ta, 'the')),
p AS (SELECT source, count(*) AS size FROM documents GROUP BY source),
k AS (SELECT 'relevancy' AS sort_by, doc_id, hits::DOUBLE / n AS k FROM h
      UNION ALL SELECT 'popularity', doc_id, size FROM h JOIN p USING (source)
      UNION ALL SELECT 'publishedAt', doc_id, n_chars FROM h),
r AS (SELECT sort_by, doc_id, row_number() OVER (PARTITION BY sort_by ORDER BY k DESC, doc_id) AS rank FROM k)
SELECT sort_by, 'the' AS query_id, rank, doc_id FROM r WHERE rank <= 20""")
def q_sorted_search(spark, sf_dir):
    """SRT-2: the sort selector, all three orders (``n_chars`` stands in for the publication time)."""
    d = table(spark, sf_dir, "documents")
    out = None
    for s in SORTS:
        r = sorted_search(d, {"abstract": F.col("text")}, _SORT_QUERIES, "doc_id", s, 20, date_col="n_chars", source_col="source") \
            .select(F.lit(s).alias("sort_by"), "query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id")
        out = r if out is None else out.unionByName(r)
    return out


@register("source_or_domain", sql=f"""
SELECT page_id, url FROM pages
WHERE {SQL_HOST} IN ('ththan.example.net', 'thther.example.org')
   OR {SQL_HOST} = 'example.com' OR ends_with({SQL_HOST}, '.example.com')""")
def q_source_or_domain(spark, sf_dir):
    """FIL-3: sources or domains, combined by OR."""
    p = table(spark, sf_dir, "pages").withColumn("site", U.host(F.col("url")))
    return filter_articles(p, sources=["ththan.example.net", "thther.example.org"], source_col="site",
                           domains=["example.com"], url_col="url").select("page_id", "url")


@register("source_lists", sql="""
SELECT lang, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM documents GROUP BY lang""")
def q_source_lists(spark, sf_dir):
    """FN-1: the sources of each language as one comma-joined list."""
    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(F.concat_ws(",", F.sort_array(F.collect_set("source"))).alias("sources"))


@register("elapsed_time", sql="""
SELECT user_id, epoch(max(ts) - min(ts))::DOUBLE AS elapsed_s, count(*) AS n FROM events GROUP BY user_id""")
def q_elapsed_time(spark, sf_dir):
    """FN-4: elapsed time between a user's first and last event (an interval, in seconds)."""
    e = table(spark, sf_dir, "events")
    gap = F.max("ts") - F.min("ts")
    secs = F.extract(F.lit("DAY"), gap) * 86400 + F.extract(F.lit("HOUR"), gap) * 3600 \
        + F.extract(F.lit("MINUTE"), gap) * 60 + F.extract(F.lit("SECOND"), gap)
    return e.groupBy("user_id").agg(secs.cast("double").alias("elapsed_s"), F.count("*").alias("n"))


@register("event_props", sql="""
SELECT event_id, (props->>'k')::BIGINT AS k FROM events""")
def q_event_props(spark, sf_dir):
    """FN-18: a JSON column parsed with an explicit schema."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@register("period_filter", sql="""
SELECT o_orderkey, o_orderdate, o_totalprice FROM orders
WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1998-07-03' AND DATE '1998-08-02'""")
def q_period_filter(spark, sf_dir):
    """FIL-4 / FN-3 / FN-4: period "30d" before a fixed as-of date, inclusive, date grain."""
    o = table(spark, sf_dir, "orders")
    return filter_articles(o, date_col="o_orderdate", period="30d", as_of="1998-08-02",
                           start="1990-01-01", end="1990-12-31") \
        .select("o_orderkey", "o_orderdate", "o_totalprice")


@register("date_window", sql="""
SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders
WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1995-03-31'""")
def q_date_window(spark, sf_dir):
    """FIL-5: absolute window given as a (y, m, d) tuple and a string."""
    o = table(spark, sf_dir, "orders")
    return o.where(date_window("o_orderdate", (1995, 1, 1), "1995-03-31")) \
        .select("o_orderkey", "o_orderdate", "o_orderstatus")


@register("site_filter", sql=f"""
SELECT page_id, url FROM pages
WHERE ({SQL_HOST} = 'ththan.example.net' OR ends_with({SQL_HOST}, '.ththan.example.net'))
  AND starts_with(regexp_extract(url, {SQL_URI}, 5), '/en/')""")
def q_site_filter(spark, sf_dir):
    """FIL-6 / SRC-8: pages of one site (any sub-host) under a path prefix."""
    p = table(spark, sf_dir, "pages")
    return p.where(U.site_filter(F.col("url"), "ththan.example.net", "/en/")).select("page_id", "url")


@register("exclude_sites", sql=f"""
SELECT page_id, url FROM pages
WHERE NOT ({SQL_HOST} IN ('spam-farm.example.org', 'cheap-pills.example.com')
           OR ends_with({SQL_HOST}, '.spam-farm.example.org') OR ends_with({SQL_HOST}, '.cheap-pills.example.com'))""")
def q_exclude_sites(spark, sf_dir):
    """FIL-5 ``exclude_websites``: drop pages whose host is (under) an excluded site."""
    p = table(spark, sf_dir, "pages")
    return filter_articles(p, url_col="url",
                           exclude_websites=["spam-farm.example.org", "cheap-pills.example.com"]) \
        .select("page_id", "url")


SQL_CANON = f"""CASE WHEN regexp_replace(regexp_replace(regexp_extract(url, {SQL_URI}, 7), '(^|&)utm_[^&]*', '', 'g'), '^&', '') = ''
  THEN regexp_replace({SQL_HOST}, '^(www|m)\\.', '') || regexp_replace(regexp_extract(url, {SQL_URI}, 5), '/+$', '')
  ELSE regexp_replace({SQL_HOST}, '^(www|m)\\.', '') || regexp_replace(regexp_extract(url, {SQL_URI}, 5), '/+$', '')
       || '?' || regexp_replace(regexp_replace(regexp_extract(url, {SQL_URI}, 7), '(^|&)utm_[^&]*', '', 'g'), '^&', '') END"""


@register("url_parts", sql=f"""
SELECT page_id, lower(regexp_extract(url, {SQL_URI}, 2)) AS scheme, {SQL_HOST} AS host,
       regexp_extract(url, {SQL_URI}, 5) AS path, regexp_extract(url, {SQL_URI}, 7) AS query,
       regexp_extract(url, {SQL_URI}, 9) AS fragment, {SQL_CANON} AS canonical_url
FROM pages""")
def q_url_parts(spark, sf_dir):
    """FN-16 / TXT-7: URL parts and the canonical URL used as de-duplication key."""
    p = table(spark, sf_dir, "pages")
    u = F.col("url")
    return p.select("page_id", U.scheme(u).alias("scheme"), U.host(u).alias("host"),
                    U.path(u).alias("path"), U.query(u).alias("query"),
                    U.fragment(u).alias("fragment"), U.canonical_url(u).alias("canonical_url"))


@register("last_wins_dedup", sql="""
SELECT md5(text) AS text_md5, max(doc_id) AS doc_id, arg_max(source, doc_id) AS source,
       arg_max(lang, doc_id) AS lang, min(doc_id) AS first_doc_id, count(*) AS copies
FROM documents GROUP BY text""")
def q_last_wins_dedup(spark, sf_dir):
    """WIN-1 / TXT-7: one row per text, the last arrival wins; first position kept."""
    d = table(spark, sf_dir, "documents").select("text", "doc_id", "source", "lang")
    k = R.keep_last(d, ["text"], ["doc_id"])
    copies = d.groupBy("text").agg(F.count("*").alias("copies"))
    return k.join(copies, "text").select(F.md5("text").alias("text_md5"), "doc_id", "source", "lang",
                                         "first_doc_id", "copies")


@register("keyed_union", sql=f"""
WITH t AS (SELECT doc_id, {SQL_WORD_TOKENS.format(x="text")} AS ta FROM documents),
u AS (
  SELECT 0 AS query_idx, doc_id, len(list_filter(ta, lambda x: x = 'the')) AS hits FROM t WHERE list_contains(ta, 'the')
  UNION ALL
  SELECT 1, doc_id, len(list_filter(ta, lambda x: x = 'and')) FROM t WHERE list_contains(ta, 'and'))
SELECT doc_id, arg_max(query_idx, query_idx) AS query_idx, arg_max(hits, query_idx) AS hits,
       min(query_idx) AS first_query_idx FROM u GROUP BY doc_id""")
def q_keyed_union(spark, sf_dir):
    """SET-1 / SET-2: results of two searches appended, keyed by id, later query wins."""
    d = table(spark, sf_dir, "documents")
    a = keyword_search(d, {"abstract": F.col("text")}, {"the": term("all", "the")}, "doc_id") \
        .select(F.lit(0).alias("query_idx"), "doc_id", F.col("hits").cast("bigint").alias("hits"))
    b = keyword_search(d, {"abstract": F.col("text")}, {"and": term("all", "and")}, "doc_id") \
        .select(F.lit(1).alias("query_idx"), "doc_id", F.col("hits").cast("bigint").alias("hits"))
    k = R.keep_last(R.union_all(a, b), ["doc_id"], ["query_idx"])
    return k.select("doc_id", F.col("query_idx"), "hits", F.col("first_query_idx"))


@register("latest_per_query", sql="""
SELECT o_orderpriority, rank, o_orderkey, o_orderdate FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) AS rank
  FROM orders) WHERE rank <= 100""")
def q_latest_per_query(spark, sf_dir):
    """SRT-1: newest first, at most 100 per query (priority stands in for the query)."""
    o = table(spark, sf_dir, "orders")
    r = R.top_n_per_group(o, ["o_orderpriority"], [F.desc("o_orderdate"), F.col("o_orderkey")], 100)
    return r.select("o_orderpriority", F.col("rank").cast("bigint").alias("rank"), "o_orderkey", "o_orderdate")


@register("paged", sql="""
WITH f AS (SELECT * FROM orders WHERE o_orderstatus = 'F'),
top AS (SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS pos
        FROM f ORDER BY o_orderdate DESC, o_orderkey LIMIT 100)
SELECT o_orderkey, o_orderdate, pos, CAST(ceil(pos / 20) AS INTEGER) AS page FROM top""")
def q_paged(spark, sf_dir):
    """WIN-6 / LIM-2 / LIM-4: page size 20, at most 100 results (5 pages)."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F")
    r = R.paged(o, [F.desc("o_orderdate"), F.col("o_orderkey")], page_size=20, max_results=100)
    return r.select("o_orderkey", "o_orderdate", F.col("pos").cast("bigint").alias("pos"), "page")


@register("offset_limit", sql="""
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 20""")
def q_offset_limit(spark, sf_dir):
    """LIM-1: ``start=20&max_results=20`` over the price order."""
    o = table(spark, sf_dir, "orders")
    return R.offset_limit(o, [F.desc("o_totalprice"), F.col("o_orderkey")], 20, 20) \
        .select("o_orderkey", "o_totalprice")


@register("headlines_per_source", sql="""
SELECT source, rank, doc_id, lang FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS rank FROM documents)
WHERE rank <= 5""")
def q_headlines_per_source(spark, sf_dir):
    """SRC-5: the latest 5 documents of every source (doc_id = arrival order)."""
    d = table(spark, sf_dir, "documents")
    r = R.top_n_per_group(d, ["source"], [F.desc("doc_id")], 5)
    return r.select("source", F.col("rank").cast("bigint").alias("rank"), "doc_id", "lang")


@register("source_catalogue", sql="""
SELECT source, lang, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY source, lang""")
def q_source_catalogue(spark, sf_dir):
    """SRC-6: source × language dimension table with counts."""
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source", "lang").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"))


@register("lookup_first_match", sql="""
WITH lk AS (SELECT d.text, arg_min(l.quality, d.doc_id) AS quality, arg_min(l.toxic, d.doc_id) AS toxic
            FROM documents d JOIN labels l USING (doc_id) GROUP BY d.text)
SELECT d.doc_id, lk.quality, lk.toxic FROM documents d LEFT JOIN lk USING (text)""")
def q_lookup_first_match(spark, sf_dir):
    """JOI-2: label looked up by text; all copies of a text take the first labelled row's value."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = table(spark, sf_dir, "labels")
    j = d.join(lab, "doc_id")
    lk = j.groupBy("text").agg(F.min_by("quality", "doc_id").alias("quality"),
                               F.min_by("toxic", "doc_id").alias("toxic"))
    return R.left_enrich(d, lk, ["text"]).select("doc_id", "quality", "toxic")


@register("text_stats", sql=f"""
SELECT lang, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars,
       CAST(sum(len(string_split(text, ' '))) AS BIGINT) AS n_words,
       CAST(sum({SQL_TOKEN_COUNT.format(x='text')}) AS BIGINT) AS n_tokens,
       CAST(sum(length(text)) + 2 * (count(*) - 1) AS BIGINT) AS concat_chars
FROM documents GROUP BY lang""")
def q_text_stats(spark, sf_dir):
    """TXT-6 / FN-7 / FN-8 / AGG-11: chars, words, tokens per language and the length
    of the "\\n\\n"-joined corpus, computed without building the concatenation."""
    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(
        F.count("*").alias("n_docs"), F.sum(F.length("text")).cast("bigint").alias("n_chars"),
        F.sum(ws_token_count("text")).cast("bigint").alias("n_words"),
        F.sum(regex_token_count("text")).cast("bigint").alias("n_tokens"),
        (F.sum(F.length("text")) + 2 * (F.count("*") - 1)).cast("bigint").alias("concat_chars"))


@register("truncate_tokens", sql="""
SELECT doc_id, length(t) AS n_chars, len(string_split(t, ' ')) AS n_words, md5(t) AS text_md5
FROM (SELECT doc_id, array_to_string(string_split(text, ' ')[1:4096], ' ') AS t FROM documents)""")
def q_truncate_tokens(spark, sf_dir):
    """FN-9: every text cut to its first 4096 space-separated words."""
    d = table(spark, sf_dir, "documents").select("doc_id", truncate_words("text", 4096).alias("t"))
    return d.select("doc_id", F.length("t").cast("bigint").alias("n_chars"),
                    ws_token_count("t").cast("bigint").alias("n_words"), F.md5("t").alias("text_md5"))


@register("concat_by_group", sql="""
SELECT conv_id, count(*) AS n_turns,
       string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS transcript
FROM conversations GROUP BY conv_id""")
def q_concat_by_group(spark, sf_dir):
    """AGG-10: ordered "\\n\\n" concatenation of every conversation's turns."""
    c = table(spark, sf_dir, "conversations")
    g = c.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("t")))).alias("_l"))
    return g.select("conv_id", "n_turns", F.array_join(F.transform("_l", lambda s: s["t"]), "\n\n").alias("transcript"))


@register("cluster_sizes", sql="""
SELECT CAST(label AS VARCHAR) AS cluster, count(*) AS n, CAST(label = -1 AS INTEGER) AS noise
FROM embeddings GROUP BY label""")
def q_cluster_sizes(spark, sf_dir):
    """AGG-1 / PRJ-4: size of every cluster; label as string and noise flag."""
    e = table(spark, sf_dir, "embeddings")
    return e.groupBy("label").agg(F.count("*").alias("n")).select(
        F.col("label").cast("string").alias("cluster"), "n", (F.col("label") == -1).cast("int").alias("noise"))


def _label_order(e):
    labels = e.select("label").distinct()
    # the distinct label set is small (one row per cluster); numbering it is a
    # one-partition window over that set only, never over the points
    return labels.select("label", F.dense_rank().over(Window.orderBy("label")).alias("cluster_order"))


@register("cluster_labels_ordered", sql="""
SELECT CAST(label AS VARCHAR) AS cluster, dense_rank() OVER (ORDER BY label) AS cluster_order
FROM (SELECT DISTINCT label FROM embeddings)""")
def q_cluster_labels_ordered(spark, sf_dir):
    """AGG-12: distinct labels, numeric order ("10" after "2"), as strings."""
    e = table(spark, sf_dir, "embeddings")
    return _label_order(e).select(F.col("label").cast("string").alias("cluster"),
                                  F.col("cluster_order").cast("bigint").alias("cluster_order"))


@register("scatter_frame", sql="""
WITH o AS (SELECT label, dense_rank() OVER (ORDER BY label) AS cluster_order FROM (SELECT DISTINCT label FROM embeddings))
SELECT vec_id AS id, round(CAST(embedding[1] AS DOUBLE), 6) AS umap_0, round(CAST(embedding[2] AS DOUBLE), 6) AS umap_1,
       CAST(label AS VARCHAR) AS cluster, CAST(label = -1 AS INTEGER) AS noise, cluster_order
FROM embeddings JOIN o USING (label)""")
def q_scatter_frame(spark, sf_dir):
    """SNK-5 / FIL-7 / PRJ-2: plot-ready table (coordinates, cluster string, noise, category order)."""
    e = table(spark, sf_dir, "embeddings")
    o = _label_order(e)
    return e.join(o, "label").select(
        F.col("vec_id").alias("id"), F.round(F.col("embedding")[0].cast("double"), 6).alias("umap_0"),
        F.round(F.col("embedding")[1].cast("double"), 6).alias("umap_1"),
        F.col("label").cast("string").alias("cluster"), (F.col("label") == -1).cast("int").alias("noise"),
        F.col("cluster_order").cast("bigint").alias("cluster_order"))
