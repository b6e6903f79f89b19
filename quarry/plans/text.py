"""Text queries: chunking, article extraction, links, prompts, packing and
summaries (SURVEY phases 3 and 7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import urls as U
from quarry.functions.text import regex_token_count, template_overhead
from quarry.operators import relational as R
from quarry.operators.chunking import chunk, recursive_chunks, token_chunks
from quarry.operators.cluster import assign_to_centroids
from quarry.operators.embed import add_hashed_terms, fit_hashed_terms
from quarry.operators.extract import extract_articles, page_links
from quarry.operators.summarize import (MAP_TEMPLATE, REDUCE_TEMPLATE, REDUCE_TOKEN_MAX, STUFF_LIMIT, STUFF_TEMPLATE,
                                        extractive_generator, map_reduce_summary, pack_windows, prompt_docs,
                                        recursive_summary, window_prompts)
from quarry.operators.vector import mean_vectors_by
from quarry.plans.corpus import SQL_CANON, SQL_HOST, SQL_TOKEN_COUNT, SQL_URI
from quarry.plans.embeddings import tfidf_sql
from quarry.plans.registry import register
from quarry.session import cut_lineage, table

NL2 = "chr(10) || chr(10)"


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---- chunking ----------------------------------------------------------------

@register("chunk_window", sql="""
WITH c AS (
  SELECT doc_id, unnest(list_transform(range(0, greatest(length(text) - 101, 0) + 1, 500),
                                       lambda s: substring(text, s + 1, 600))) AS chunk,
         unnest(range(0, len(range(0, greatest(length(text) - 101, 0) + 1, 500)))) AS split_idx
  FROM documents WHERE length(text) > 0)
SELECT doc_id, split_idx, CAST(doc_id AS VARCHAR) || '_split-' || CAST(split_idx AS VARCHAR) AS chunk_id,
       length(chunk) AS n_chars, md5(chunk) AS chunk_md5 FROM c""")
def q_chunk_window(spark, sf_dir):
    """TXT-1 (window mode) / WIN-2 / FN-6: 600-char windows, 100 overlap, ids ``{key}_split-{idx}``."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    c = chunk(d, "text", "doc_id", mode="window")
    return c.select("doc_id", F.col("split_idx").cast("bigint").alias("split_idx"), "chunk_id",
                    F.length("chunk").cast("bigint").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


@register("chunk_tokens", sql=f"""
WITH RECURSIVE p0 AS (
  SELECT doc_id, lang, unnest(string_split(text, {NL2})) AS piece,
         unnest(range(1, len(string_split(text, {NL2})) + 1)) AS ord FROM documents),
p AS (SELECT doc_id, lang, regexp_replace(piece, '^\\s+|\\s+$', '', 'g') AS piece, ord FROM p0),
pr AS (SELECT doc_id, lang, piece, {SQL_TOKEN_COUNT.format(x='piece')} AS t,
              row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM p WHERE piece <> ''),
w AS (SELECT doc_id, i, 0 AS split_idx, t AS used FROM pr WHERE i = 1
      UNION ALL
      SELECT pr.doc_id, pr.i,
             CASE WHEN w.used + pr.t > 1000 THEN w.split_idx + 1 ELSE w.split_idx END,
             CASE WHEN w.used + pr.t > 1000 THEN pr.t ELSE w.used + pr.t END
      FROM w JOIN pr ON pr.doc_id = w.doc_id AND pr.i = w.i + 1),
c AS (SELECT w.doc_id, any_value(pr.lang) AS lang, w.split_idx,
             string_agg(pr.piece, {NL2} ORDER BY pr.i) AS chunk
      FROM w JOIN pr USING (doc_id, i) GROUP BY w.doc_id, w.split_idx)
SELECT doc_id, lang, CAST(split_idx AS BIGINT) AS split_idx, {SQL_TOKEN_COUNT.format(x='chunk')} AS n_tokens, md5(chunk) AS chunk_md5 FROM c""")
def q_chunk_tokens(spark, sf_dir):
    """TXT-2: paragraphs packed up to 1000 tokens (overlap 0); metadata copied to every chunk."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    c = d.select("doc_id", "lang", F.posexplode(token_chunks("text", 1000)).alias("split_idx", "chunk"))
    return c.select("doc_id", "lang", F.col("split_idx").cast("bigint").alias("split_idx"),
                    regex_token_count("chunk").cast("bigint").alias("n_tokens"), F.md5("chunk").alias("chunk_md5"))


@register("chunk_ids", sql=f"""
WITH c AS (
  SELECT doc_id, source, lang, split_part(text, chr(10), 1) AS title,
         unnest(list_transform(range(0, greatest(length(text) - 101, 0) + 1, 500),
                               lambda s: substring(text, s + 1, 600))) AS chunk,
         unnest(range(0, len(range(0, greatest(length(text) - 101, 0) + 1, 500)))) AS split_idx
  FROM documents WHERE length(text) > 0)
SELECT CAST(doc_id AS VARCHAR) || '_split-' || CAST(split_idx AS VARCHAR) AS id, source AS url,
       md5(title) AS title_md5, md5(chunk) AS text_md5, lang AS category FROM c""")
def q_chunk_ids(spark, sf_dir):
    """TXT-4 (without vectors) / TXT-3: the chunk table ``(id, url, title, text, category)``."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text",
                                                  F.substring_index("text", "\n", 1).alias("title"))
    c = chunk(d, "text", "doc_id", mode="window")
    return c.select(F.col("chunk_id").alias("id"), F.col("source").alias("url"),
                    F.md5("title").alias("title_md5"), F.md5("chunk").alias("text_md5"),
                    F.col("lang").alias("category"))


def _level_sql(segs: str, sep: str) -> str:
    """One pass of the recursive splitter over a list of {s, n, f} (DuckDB)."""
    if not sep:
        cut = "list_transform(range(0, x.n), lambda i: {'s': NULL::VARCHAR, 'n': 1, 'f': i = 0})"
        return f"flatten(list_transform({segs}, lambda x: CASE WHEN x.s IS NULL THEN [x] ELSE {cut} END))"
    q = {"\n\n": NL2, "\n": "chr(10)", " ": "' '"}[sep]
    parts = (f"list_filter(list_transform(string_split(x.s, {q}), lambda p, i: CASE WHEN i > 1 THEN {q} || p ELSE p END), lambda p: p <> '')")
    cut = (f"list_transform([{parts}], lambda ps: list_transform(ps, lambda p, i: {{'s': CASE WHEN length(p) >= 600 THEN p END, "
           "'n': length(p)::BIGINT, 'f': i = 1 OR length(ps[i - 1]) >= 600}))[1]")
    return f"flatten(list_transform({segs}, lambda x: CASE WHEN x.s IS NOT NULL AND contains(x.s, {q}) THEN {cut} ELSE [x] END))"


_RECURSIVE_SQL = rf"""
WITH l0 AS (SELECT doc_id, text, [{{'s': text, 'n': length(text)::BIGINT, 'f': true}}] AS g FROM documents WHERE text <> ''),
l1 AS (SELECT doc_id, text, {_level_sql('g', chr(10) * 2)} AS g FROM l0),
l2 AS (SELECT doc_id, text, {_level_sql('g', chr(10))} AS g FROM l1),
l3 AS (SELECT doc_id, text, {_level_sql('g', ' ')} AS g FROM l2),
l4 AS (SELECT doc_id, text, {_level_sql('g', '')} AS g FROM l3),
fold AS (SELECT doc_id, text, list_reduce(
    list_transform(g, lambda x: {{'n': x.n, 'f': x.f, 'o': []::BIGINT[], 'c': []::BIGINT[], 'b': 0::BIGINT}}),
    lambda a, x: {{'n': 0::BIGINT, 'f': false,
      'o': CASE WHEN len(a.c) > 0 AND (x.f OR a.b - a.c[1] + x.n > 600) THEN a.o || [a.c[1], a.b] ELSE a.o END,
      'c': list_append(CASE WHEN x.f THEN []::BIGINT[]
                            WHEN len(a.c) > 0 AND a.b - a.c[1] + x.n > 600
                            THEN list_filter(a.c, lambda s: a.b - s <= 100 AND a.b - s + x.n <= 600) ELSE a.c END, a.b),
      'b': a.b + x.n}},
    {{'n': 0::BIGINT, 'f': false, 'o': []::BIGINT[], 'c': []::BIGINT[], 'b': 0::BIGINT}}) AS r FROM l4),
sp AS (SELECT doc_id, text, CASE WHEN len(r.c) > 0 THEN r.o || [r.c[1], r.b] ELSE r.o END AS o FROM fold),
ch AS (SELECT doc_id, list_filter(list_transform(range(1, len(o) // 2 + 1), lambda i:
         regexp_replace(substring(text, o[2 * i - 1] + 1, o[2 * i] - o[2 * i - 1]), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')), lambda c: c <> '') AS c FROM sp)
SELECT doc_id, (i - 1)::INTEGER AS split_idx, length(c[i])::INTEGER AS n_chars, md5(c[i]) AS chunk_md5
FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM ch)"""


@register("chunk_recursive", sql=_RECURSIVE_SQL)
def q_chunk_recursive(spark, sf_dir):
    """TXT-1 (recursive mode, 600/100), native: a pass per separator and a fold over lengths."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    c = d.select("doc_id", F.posexplode(recursive_chunks("text")).alias("split_idx", "chunk"))
    return c.select("doc_id", "split_idx", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


# ---- article extraction ------------------------------------------------------

_DROP = ["(?s)<!--.*?-->", "(?is)<script\\b.*?</script\\s*>", "(?is)<style\\b.*?</style\\s*>",
         "(?is)<nav\\b.*?</nav\\s*>", "(?is)<footer\\b.*?</footer\\s*>", "(?is)<aside\\b.*?</aside\\s*>"]
_ENT = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"),
        ("&apos;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def _sql_unescape(x: str) -> str:
    for e, c in _ENT:
        x = f"replace({x}, '{e}', '{c}')"
    return x


def _sql_clean(x: str) -> str:
    for p in _DROP:
        x = f"regexp_replace({x}, '{p}', ' ', 'g')"
    return x


def _extract_sql() -> str:
    art = "regexp_extract(c, '(?is)<article\\b[^>]*>(.*)</article\\s*>', 1)"
    body = "regexp_extract(c, '(?is)<body\\b[^>]*>(.*)</body\\s*>', 1)"
    title = _sql_unescape("regexp_replace(regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1), '<[^>]*>', '', 'g')")
    txt = _sql_unescape("regexp_replace(regexp_replace(m, '(?i)<(/?p|br|/?h[1-6]|/?li|/?div|/?tr|/?blockquote)\\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g')")
    return f"""
pg AS (SELECT page_id, url, {SQL_HOST} AS host, trim({title}) AS title, {_sql_clean('html')} AS c FROM pages),
mb AS (SELECT page_id, url, host, title, CASE WHEN {art} <> '' THEN {art} ELSE {body} END AS m FROM pg),
ln0 AS (SELECT page_id, host, unnest(string_split({txt}, chr(10))) AS line0,
               unnest(range(0, len(string_split({txt}, chr(10))))) AS k FROM mb),
ln1 AS (SELECT page_id, host, trim(regexp_replace(line0, '\\s+', ' ', 'g')) AS line, k FROM ln0),
ln AS (SELECT page_id, host, line, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS pos
       FROM ln1 WHERE line <> ''),
rep AS (SELECT host, line FROM ln GROUP BY host, line HAVING count(DISTINCT page_id) >= 3),
kept AS (SELECT ln.* FROM ln ANTI JOIN rep USING (host, line)),
art AS (SELECT mb.page_id, mb.url, mb.host, mb.title,
               (SELECT string_agg(line, {NL2} ORDER BY pos) FROM kept WHERE kept.page_id = mb.page_id) AS full_text,
               (SELECT count(*) FROM kept WHERE kept.page_id = mb.page_id) AS n_paragraphs
        FROM mb)"""


@register("article_extract", sql=f"""
WITH {_extract_sql()}
SELECT page_id, host, title, n_paragraphs, full_text FROM art""")
def q_article_extract(spark, sf_dir):
    """TXT-8 / SRC-9: main text of every landed page, boilerplate lines (on ≥3 pages of a host) removed."""
    a = extract_articles(table(spark, sf_dir, "pages"))
    return a.select("page_id", "host", "title", F.size("paragraphs").cast("bigint").alias("n_paragraphs"),
                    "full_text")


@register("page_links", sql=f"""
WITH lk AS (
  SELECT page_id, lower(regexp_extract(url, {SQL_URI}, 2)) AS s, {SQL_HOST} AS site,
         regexp_extract(regexp_extract(url, {SQL_URI}, 5), '^(.*/)', 1) AS dir,
         unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages),
rs AS (SELECT page_id, site,
         CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href
              WHEN starts_with(href, '//') THEN s || ':' || href
              WHEN starts_with(href, '/') THEN s || '://' || site || href
              ELSE s || '://' || site || CASE WHEN dir = '' THEN '/' ELSE dir END || href END AS link FROM lk),
k AS (SELECT *, CASE WHEN len(list_filter(string_split(regexp_extract(link, {SQL_URI}, 5), '/'), lambda x: x <> '')) <= 1
                     THEN 'category' ELSE 'article' END AS kind FROM rs)
SELECT site, link, kind, count(DISTINCT page_id) AS n_pages FROM k GROUP BY site, link, kind""")
def q_page_links(spark, sf_dir):
    """SRC-10: distinct category/article links of every site with the pages that carry them."""
    lk = page_links(table(spark, sf_dir, "pages"))
    return lk.groupBy("site", "link", "kind").agg(F.countDistinct("page_id").alias("n_pages"))


@register("enrich_full_text", sql=f"""
WITH {_extract_sql()},
keyed AS (SELECT {SQL_CANON} AS canonical_url, page_id FROM pages),
arts AS (SELECT canonical_url, min(page_id) AS first_page_id FROM keyed GROUP BY canonical_url),
ext AS (SELECT k.canonical_url, arg_max(a.full_text, a.page_id) AS full_text
        FROM keyed k JOIN art a USING (page_id) WHERE a.full_text IS NOT NULL GROUP BY k.canonical_url)
SELECT canonical_url, first_page_id, length(full_text) AS n_chars, md5(full_text) AS text_md5
FROM arts LEFT JOIN ext USING (canonical_url)""")
def q_enrich_full_text(spark, sf_dir):
    """JOI-3 / TXT-7 / SRC-11: article list keyed by canonical URL, left-joined to the
    extracted text of the latest page with that URL (new column ``full_text``)."""
    pages = table(spark, sf_dir, "pages")
    keyed = pages.select(U.canonical_url(F.col("url")).alias("canonical_url"), "page_id")
    arts = keyed.groupBy("canonical_url").agg(F.min("page_id").alias("first_page_id"))
    ext = extract_articles(pages).where(F.col("full_text").isNotNull()).select("page_id", "full_text")
    ext = R.keep_last(keyed.join(ext, "page_id"), ["canonical_url"], ["page_id"], keep_first_seq=False) \
        .select("canonical_url", "full_text")
    j = R.left_enrich(arts, ext, ["canonical_url"])
    return j.select("canonical_url", "first_page_id", F.length("full_text").cast("bigint").alias("n_chars"),
                    F.md5("full_text").alias("text_md5"))


# ---- prompts, packing, summaries --------------------------------------------

_PAGE_CONTENT_SQL = "printf('Article n°%d -- %s', doc_id, text)"
_OVERHEAD_SQL = SQL_TOKEN_COUNT.format(x="replace(" + _sql_str(STUFF_TEMPLATE) + ", '{text}', ' ')")


def _docs(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    p = prompt_docs(d, "doc_id", "text", ["doc_id", "lang", "source", "n_chars"])
    return p.withColumn("tokens", regex_token_count("page_content"))


@register("prompt_docs", sql=f"""
SELECT doc_id, length({_PAGE_CONTENT_SQL}) AS n_chars, md5({_PAGE_CONTENT_SQL}) AS content_md5,
       to_json({{'doc_id': doc_id, 'lang': lang, 'source': source, 'n_chars': n_chars}}) AS metadata
FROM documents""")
def q_prompt_docs(spark, sf_dir):
    """PRJ-5 / FN-17: ``Article n°{i} -- {text}`` documents with JSON metadata."""
    p = _docs(spark, sf_dir)
    return p.select("doc_id", F.length("page_content").cast("bigint").alias("n_chars"),
                    F.md5("page_content").alias("content_md5"), "metadata")


@register("prompt_length", sql=f"""
SELECT lang, count(*) AS n_docs,
       CAST(sum({SQL_TOKEN_COUNT.format(x=_PAGE_CONTENT_SQL)}) + max({_OVERHEAD_SQL}) AS BIGINT) AS prompt_tokens
FROM documents GROUP BY lang""")
def q_prompt_length(spark, sf_dir):
    """SUM-2: prompt length (regex tokens) of stuffing all of a group's documents."""
    p = _docs(spark, sf_dir)
    ov = template_overhead(STUFF_TEMPLATE)
    return p.groupBy("lang").agg(F.count("*").alias("n_docs"),
                                 (F.sum("tokens") + F.lit(ov)).cast("bigint").alias("prompt_tokens"))


def _windows_sql() -> str:
    return f"""
d AS (SELECT lang, doc_id, {_PAGE_CONTENT_SQL} AS pc, {SQL_TOKEN_COUNT.format(x=_PAGE_CONTENT_SQL)} AS t,
             row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents),
ov AS (SELECT {_OVERHEAD_SQL} AS o),
w AS (SELECT lang, i, 0 AS win, t AS used FROM d WHERE i = 1
      UNION ALL
      SELECT d.lang, d.i,
             CASE WHEN (SELECT o FROM ov) + w.used + d.t > {STUFF_LIMIT} THEN w.win + 1 ELSE w.win END,
             CASE WHEN (SELECT o FROM ov) + w.used + d.t > {STUFF_LIMIT} THEN d.t ELSE w.used + d.t END
      FROM w JOIN d ON d.lang = w.lang AND d.i = w.i + 1),
wd AS (SELECT d.*, w.win FROM d JOIN w USING (lang, i))"""


@register("pack_windows", sql=f"""
WITH RECURSIVE {_windows_sql()}
SELECT lang, CAST(win AS BIGINT) AS window, count(*) AS n_docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc,
       CAST(sum(t) AS BIGINT) AS tokens FROM wd GROUP BY lang, win""")
def q_pack_windows(spark, sf_dir):
    """SUM-3 / WIN-7: greedy adaptive windows per language, prompt limit 6000 tokens."""
    p = _docs(spark, sf_dir)
    w = pack_windows(p, ["lang"], "doc_id", "tokens", STUFF_LIMIT, template_overhead(STUFF_TEMPLATE))
    return w.groupBy("lang", "window").agg(
        F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"),
        F.sum("tokens").cast("bigint").alias("tokens"))


@register("stuff_prompt", sql=f"""
WITH RECURSIVE {_windows_sql()},
pr AS (SELECT lang, win, count(*) AS n_docs,
              replace({_sql_str(STUFF_TEMPLATE)}, '{{text}}', string_agg(pc, {NL2} ORDER BY doc_id)) AS prompt
       FROM wd GROUP BY lang, win)
SELECT lang, CAST(win AS BIGINT) AS window, n_docs, length(prompt) AS n_chars, md5(prompt) AS prompt_md5 FROM pr""")
def q_stuff_prompt(spark, sf_dir):
    """SUM-1 / FN-10 / AGG-10: the "stuff" prompt of every packed window."""
    p = _docs(spark, sf_dir)
    w = pack_windows(p, ["lang"], "doc_id", "tokens", STUFF_LIMIT, template_overhead(STUFF_TEMPLATE))
    pr = window_prompts(w, ["lang"], "doc_id", "page_content", STUFF_TEMPLATE, "text")
    return pr.select("lang", "window", "n_docs", F.length("prompt").cast("bigint").alias("n_chars"),
                     F.md5("prompt").alias("prompt_md5"))


# ---- summaries in SQL: the levels are unrolled, a level without rows stays empty --------------------------

SUMMARY_LEVELS = 6


def _summaries_sql(name: str, source: str, template: str, key: str) -> str:
    """``{name}(key…, s)``: the default summary of ``prompt`` in ``source`` (key: its key columns)."""
    body = "prompt"
    for part in extractive_generator(template).fixed:
        body = f"replace({body}, {_sql_str(part)}, chr(10))"
    return rf"""
{name}_s AS (SELECT {key}, len(s) AS n, unnest(s) AS s, unnest(range(len(s))) AS pos FROM (
    SELECT {key}, list_filter(list_transform(string_split(regexp_replace({body}, '([.!?])[ \t\n\r\f]+', '\1' || chr(10), 'g'), chr(10)),
      lambda x: regexp_replace(x, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')), lambda x: x <> '') AS s FROM {source})),
{name}_w AS (SELECT {key}, n, pos, w, count(*) AS tf FROM (
    SELECT {key}, n, pos, unnest(regexp_extract_all(lower(s), '[\p{{L}}\p{{N}}]+')) AS w FROM {name}_s) GROUP BY ALL),
{name}_c AS (SELECT {key}, pos, round(sum(tf * ln(n / df)), 9) AS score FROM (
    SELECT *, count(*) OVER (PARTITION BY {key}, w) AS df FROM {name}_w) GROUP BY {key}, pos),
{name}_r AS (SELECT s.*, row_number() OVER (PARTITION BY {", ".join("s." + k for k in key.split(", "))} ORDER BY coalesce(score, 0) DESC, pos) AS r
    FROM {name}_s s LEFT JOIN {name}_c USING ({key}, pos)),
{name} AS (SELECT {", ".join("p." + k for k in key.split(", "))}, coalesce(string_agg(r.s, ' ' ORDER BY r.pos), '') AS s
    FROM {source} p LEFT JOIN (SELECT * FROM {name}_r WHERE r <= 3) r USING ({key}) GROUP BY ALL)"""


def _pack_sql(name: str, source: str, limit: int, overhead: str) -> str:
    """``{name}(g, i, c, t, win)``: greedy windows over ``source(g, i, c, t)``, i = 1, 2, … in each g."""
    return f"""
{name}_w AS (SELECT g, i, 0 AS win, t AS used FROM {source} WHERE i = 1
  UNION ALL SELECT d.g, d.i, CASE WHEN {overhead} + w.used + d.t > {limit} THEN w.win + 1 ELSE w.win END,
                   CASE WHEN {overhead} + w.used + d.t > {limit} THEN d.t ELSE w.used + d.t END
  FROM {name}_w w JOIN {source} d ON d.g = w.g AND d.i = w.i + 1),
{name} AS (SELECT d.g, d.i, d.c, d.t, w.win FROM {source} d JOIN {name}_w w USING (g, i))"""


def _tokens(x: str) -> str:
    return SQL_TOKEN_COUNT.format(x=x)


def recursive_sql(first: str) -> str:
    """CTEs of the recursive summary over ``first(g, i, c, t)``; the result is ``done(g, summary, levels)``."""
    ctes, ends, source = [], [], first
    for j in range(1, SUMMARY_LEVELS + 1):
        before = f"(SELECT g, count(*) AS nb FROM p{j - 1} GROUP BY g)" if j > 1 else "(SELECT g, NULL::BIGINT AS nb FROM d0 WHERE false)"
        ctes.append(_pack_sql(f"p{j}", source, STUFF_LIMIT, f"({_OVERHEAD_SQL})"))
        ctes.append(f"""
q{j} AS (SELECT g, win, replace({_sql_str(STUFF_TEMPLATE)}, '{{text}}', string_agg(c, {NL2} ORDER BY i, c)) AS prompt FROM p{j} GROUP BY g, win)""")
        ctes.append(_summaries_sql(f"s{j}", f"q{j}", STUFF_TEMPLATE, "g, win"))
        ctes.append(f"""
o{j} AS (SELECT p.g, (max(p.win) = 0 OR coalesce(count(*) >= any_value(b.nb), false)) AS over FROM p{j} p LEFT JOIN {before} b USING (g) GROUP BY p.g),
d{j} AS (SELECT g, win + 1 AS i, s AS c, {_tokens('s')} AS t FROM s{j} JOIN o{j} USING (g) WHERE NOT over)""")
        ends.append(f"SELECT g, string_agg(s, {NL2} ORDER BY win) AS summary, {j} AS levels FROM s{j} JOIN o{j} USING (g) WHERE over GROUP BY g")
        source = f"d{j}"
    return ",".join(ctes) + f""",
done AS ({" UNION ALL ".join(ends)})"""


_FIRST_SQL = f"d0 AS (SELECT lang AS g, i, pc AS c, t FROM (SELECT lang, {_PAGE_CONTENT_SQL} AS pc, {_tokens(_PAGE_CONTENT_SQL)} AS t, " \
             "row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents))"


@register("recursive_summary", sql=f"""
WITH RECURSIVE {_FIRST_SQL}, {recursive_sql('d0')}
SELECT g AS lang, summary, levels FROM done""")
def q_recursive_summary(spark, sf_dir):
    """SUM-4 / GEN-1: per-language recursive summary with the default extractive generator."""
    p = _docs(spark, sf_dir)
    return recursive_summary(p, ["lang"], "doc_id", "page_content")


def _map_reduce_sql() -> str:
    ctes, source = [], "c0"
    for j in range(1, SUMMARY_LEVELS + 1):
        moved = f"NOT (count(*) = any_value(b.n) AND sum(x.t) = any_value(b.tok))" if j > 1 else "true"
        before = f"LEFT JOIN (SELECT g, count(*) AS n, sum(t) AS tok FROM c{j - 2} GROUP BY g) b USING (g)" if j > 1 else ""
        ctes.append(f"""
t{j} AS (SELECT x.g, sum(x.t) > {REDUCE_TOKEN_MAX} AND count(*) > 1 AND coalesce({moved}, true) AS todo FROM {source} x {before} GROUP BY x.g),
e{j} AS (SELECT * FROM {source} JOIN t{j} USING (g) WHERE todo)""")
        ctes.append(_pack_sql(f"p{j}", f"e{j}", REDUCE_TOKEN_MAX, "0"))
        ctes.append(f"""
q{j} AS (SELECT g, win, replace({_sql_str(REDUCE_TEMPLATE)}, '{{doc_summaries}}', string_agg(c, {NL2} ORDER BY i, c)) AS prompt FROM p{j} GROUP BY g, win)""")
        ctes.append(_summaries_sql(f"s{j}", f"q{j}", REDUCE_TEMPLATE, "g, win"))
        ctes.append(f"""
c{j} AS (SELECT g, i, c, t FROM {source} JOIN t{j} USING (g) WHERE NOT todo
  UNION ALL SELECT g, win + 1, s, {_tokens('s')} FROM s{j})""")
        source = f"c{j}"
    return ",".join(ctes) + f""",
qf AS (SELECT g, 0 AS win, count(*) AS n_docs, replace({_sql_str(REDUCE_TEMPLATE)}, '{{doc_summaries}}', string_agg(c, {NL2} ORDER BY i, c)) AS prompt
       FROM {source} GROUP BY g),""" + _summaries_sql("sf", "qf", REDUCE_TEMPLATE, "g, win")


@register("map_reduce_summary", sql=rf"""
WITH RECURSIVE p0 AS (
  SELECT doc_id, lang, unnest(string_split(text, {NL2})) AS piece, unnest(range(1, len(string_split(text, {NL2})) + 1)) AS ord FROM documents),
pr AS (SELECT doc_id, lang, piece, {_tokens('piece')} AS t, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i
  FROM (SELECT doc_id, lang, regexp_replace(piece, '^\s+|\s+$', '', 'g') AS piece, ord FROM p0) WHERE piece <> ''),
w AS (SELECT doc_id, i, 0 AS split_idx, t AS used FROM pr WHERE i = 1
  UNION ALL SELECT pr.doc_id, pr.i, CASE WHEN w.used + pr.t > 1000 THEN w.split_idx + 1 ELSE w.split_idx END,
                   CASE WHEN w.used + pr.t > 1000 THEN pr.t ELSE w.used + pr.t END FROM w JOIN pr ON pr.doc_id = w.doc_id AND pr.i = w.i + 1),
ck AS (SELECT w.doc_id, w.split_idx, string_agg(pr.piece, {NL2} ORDER BY pr.i) AS chunk FROM w JOIN pr USING (doc_id, i) GROUP BY ALL),
qm AS (SELECT d.lang AS g, row_number() OVER (PARTITION BY d.lang ORDER BY d.doc_id, ck.split_idx) AS win,
         replace({_sql_str(MAP_TEMPLATE)}, '{{docs}}', coalesce(ck.chunk, '')) AS prompt FROM documents d LEFT JOIN ck USING (doc_id)),
{_summaries_sql('sm', 'qm', MAP_TEMPLATE, 'g, win')},
c0 AS (SELECT g, win AS i, s AS c, {_tokens('s')} AS t FROM sm), {_map_reduce_sql()}
SELECT sf.g AS lang, n_docs, sf.s AS summary FROM sf JOIN qf USING (g)""")
def q_map_reduce_summary(spark, sf_dir):
    """SUM-5: chunk → map prompt → collapse ≤4000 tokens → reduce prompt, per language."""
    d = table(spark, sf_dir, "documents")
    return map_reduce_summary(d, ["lang"], "doc_id", "text")


def _digest_sql() -> str:
    return f"""
{tfidf_sql('d', 'documents', 'doc_id', 'text')},
cn AS (SELECT lang, list(m ORDER BY i) AS c FROM (SELECT lang, i, avg(e) AS m FROM (
    SELECT lang, unnest(v) AS e, unnest(range(len(v))) AS i FROM d_v JOIN documents ON doc_id = d_v.id WHERE lang IS NOT NULL) GROUP BY ALL) GROUP BY lang),
ds AS (SELECT d_v.id, cn.lang, list_sum(list_transform(list_zip(v, c), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS distance FROM d_v, cn),
cl AS (SELECT id AS doc_id, arg_min(lang, (distance, lang)) AS cluster FROM ds GROUP BY id HAVING min(distance) < 1.0),
d0 AS (SELECT cluster AS g, row_number() OVER (PARTITION BY cluster ORDER BY doc_id) AS i, pc AS c, t FROM (
    SELECT doc_id, {_PAGE_CONTENT_SQL} AS pc, {_tokens(_PAGE_CONTENT_SQL)} AS t FROM documents) JOIN cl USING (doc_id))"""


@register("cluster_digest", sql=f"""
WITH RECURSIVE {_digest_sql()}, {recursive_sql('d0')}
SELECT g AS cluster, summary, levels FROM done""")
def q_cluster_digest(spark, sf_dir):
    """SUM-6: a summary of every cluster of the whole corpus.  Documents join the language centroid of
    their term vectors that is nearest; those far from all are noise (-1) and left out."""
    p = _docs(spark, sf_dir)
    idf = fit_hashed_terms(p, "doc_id", "text", 256)
    v = cut_lineage(add_hashed_terms(p.select("doc_id", "lang", "text"), "text", idf, 256).drop("text"))
    a = assign_to_centroids(v, mean_vectors_by(v.where("lang IS NOT NULL"), "lang", "vector"), id_col="doc_id", vec_col="vector",
                            cid_col="lang")
    cluster = F.when(F.col("distance") < 1.0, F.col("cluster")).otherwise("-1")
    j = p.join(a.select("doc_id", cluster.alias("cluster")), "doc_id").where(F.col("cluster") != "-1")
    return recursive_summary(j, ["cluster"], "doc_id", "page_content")


@register("single_cluster", sql="""
SELECT vec_id, label FROM embeddings WHERE label = 3""")
def q_single_cluster(spark, sf_dir):
    """FIL-7: the members of one cluster."""
    return table(spark, sf_dir, "embeddings").where(F.col("label") == 3).select("vec_id", "label")
