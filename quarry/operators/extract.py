"""Article extraction from landed HTML (TXT-8, SRC-9/10/11, JOI-3).

All steps are native regular expressions (Java regex / RE2 common subset):
drop comments, scripts, styles, navigation and footers; keep the
``<article>`` element (fallback ``<body>``); paragraph boundaries
(``<p>``, ``<br>``, headings, list items, ``<div>``) become line breaks;
remaining tags are stripped; a fixed entity list is unescaped.  The
corpus-level step drops lines that repeat on at least ``min_pages`` pages of
the same host (boilerplate): lines are extracted once into a written table,
counted per (host, line hash) with partial sums, and anti-joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import urls as U
from quarry.session import cut_lineage

# Patterns of the extraction job.
DROP_BLOCKS = [
    r"(?s)<!--.*?-->",
    r"(?is)<script\b.*?</script\s*>",
    r"(?is)<style\b.*?</style\s*>",
    r"(?is)<nav\b.*?</nav\s*>",
    r"(?is)<footer\b.*?</footer\s*>",
    r"(?is)<aside\b.*?</aside\s*>",
]
ARTICLE = r"(?is)<article\b[^>]*>(.*)</article\s*>"
BODY = r"(?is)<body\b[^>]*>(.*)</body\s*>"
TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
BREAKS = r"(?i)<(/?p|br|/?h[1-6]|/?li|/?div|/?tr|/?blockquote)\b[^>]*>"
TAG = r"<[^>]*>"
# Entities in the order they are unescaped (&amp; last).
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
            ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
HREF = r"""href="([^"]*)\""""


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unescape(x: Column) -> Column:
    for ent, ch in ENTITIES:
        x = F.replace(x, F.lit(ent), F.lit(ch))
    return x


def clean_html(html) -> Column:
    x = _c(html)
    for p in DROP_BLOCKS:
        x = F.regexp_replace(x, p, " ")
    return x


def main_block(html) -> Column:
    x = clean_html(html)
    art = F.regexp_extract(x, ARTICLE, 1)
    return F.when(art != "", art).otherwise(F.regexp_extract(x, BODY, 1))


def paragraphs(html) -> Column:
    """Array of non-empty, whitespace-normalised text lines of the main block."""
    body = F.regexp_replace(main_block(html), BREAKS, "\n")
    text = unescape(F.regexp_replace(body, TAG, ""))
    lines = F.transform(F.split(text, "\n", -1), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    return F.filter(lines, lambda s: s != "")


def page_title(html) -> Column:
    return F.trim(unescape(F.regexp_replace(F.regexp_extract(_c(html), TITLE, 1), TAG, "")))


def extract_articles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                     html_col: str = "html", min_pages: int | None = 3) -> DataFrame:
    """``(id, url, host, title, paragraphs, full_text)``; ``full_text`` is the
    paragraphs joined by a blank line, NULL when nothing is left.  Rows are told
    apart by a stored row number, so repeated and null ids keep their own text."""
    base = cut_lineage(pages.select(id_col, url_col, F.monotonically_increasing_id().alias("_row"), U.host(F.col(url_col)).alias("host"),
                                    page_title(html_col).alias("title"), paragraphs(html_col).alias("_p")))
    if min_pages:
        key = [F.xxhash64(F.lit(1), "line").alias("_h1"), F.xxhash64(F.lit(2), "line").alias("_h2")]
        # each line once per page, so that a plain count (partial sums) counts pages
        rep = base.select("host", F.explode(F.array_distinct("_p")).alias("line")).groupBy("host", *key).count() \
            .where(F.col("count") >= min_pages).drop("count")
        lines = base.select("_row", "host", F.posexplode("_p").alias("pos", "line")).select("*", *key)
        paras = lines.join(rep, ["host", "_h1", "_h2"], "left_anti").groupBy("_row").agg(
            F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("_l"))
        base = base.drop("_p").join(
            paras.select("_row", F.transform("_l", lambda s: s["line"]).alias("_p")), "_row", "left")
    p = F.coalesce(F.col("_p"), F.array().cast("array<string>"))
    return base.select(id_col, url_col, "host", "title", p.alias("paragraphs"),
                       F.when(F.size(p) > 0, F.array_join(p, "\n\n")).alias("full_text"))


def page_links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
               html_col: str = "html") -> DataFrame:
    """SRC-10: links of every page, resolved against the page URL and
    classified: one path segment -> ``category``, deeper -> ``article``."""
    u = F.col(url_col)
    lk = pages.select(id_col, U.scheme(u).alias("_s"), U.host(u).alias("site"),
                      F.regexp_extract(U.path(u), r"^(.*/)", 1).alias("_dir"),
                      F.explode(F.regexp_extract_all(F.col(html_col), F.lit(HREF), 1)).alias("href"))
    h = F.col("href")
    base_dir = F.when(F.col("_dir") == "", F.lit("/")).otherwise(F.col("_dir"))
    resolved = (F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h)
                .when(h.startswith("//"), F.concat(F.col("_s"), F.lit(":"), h))
                .when(h.startswith("/"), F.concat(F.col("_s"), F.lit("://"), F.col("site"), h))
                .otherwise(F.concat(F.col("_s"), F.lit("://"), F.col("site"), base_dir, h)))
    out = lk.select(id_col, "site", resolved.alias("link"))
    segs = F.size(F.filter(F.split(U.path(F.col("link")), "/", -1), lambda s: s != ""))
    return out.withColumn("kind", F.when(segs <= 1, F.lit("category")).otherwise(F.lit("article")))
