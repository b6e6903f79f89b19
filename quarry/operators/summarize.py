"""Prompting and summarisation (PRJ-5, FN-10, SUM-1..6, WIN-7, GEN-1, UDF-3/4).

Text generation is a pluggable batch function ``fn(list[str]) -> list[str]``
run with ``mapInPandas`` (one call per Arrow batch; a model would be loaded
once per Python worker by the caller's function).  The built-in default is a
deterministic extractive summariser made of joins and windows, which SQL can
repeat, so every operator runs offline.

All group-level operators take the group key first (cluster, lang, …), so one
job serves every group; concatenations only ever happen inside a packed
window, whose size is bounded by the token limit.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import PARAGRAPH_SEP, fill_template, template_overhead, token_count
from quarry.operators.sequence import greedy_windows, null_safe_join, numbered
from quarry.session import cut_lineage

# Prompt templates.
STUFF_TEMPLATE = """<s>[INST]You will be provided with a list of scientific paper abstracts that you must summarize.
Write a concise summary focusing on the theme that is common to all papers and covers all of them.
Here is the list of abtracts:
"{text}"
CONCISE SUMMARY: [/INST]"""
MAP_TEMPLATE = """The following is a set of documents
{docs}
Based on this list of docs, please identify the main themes
Helpful Answer:"""
REDUCE_TEMPLATE = """The following is set of summaries:
{doc_summaries}
Take these and distill it into a final, consolidated summary of the main themes.
Helpful Answer:"""
RAG_TEMPLATE = """Answer the question based only on the following context:
{context}

Question: {question}
"""
ARTICLE_FORMAT = "Article n°%d -- %s"
STUFF_LIMIT = 6000
REDUCE_TOKEN_MAX = 4000


def prompt_docs(df: DataFrame, id_col: str, text_col: str, meta_cols: list[str]) -> DataFrame:
    """PRJ-5: ``page_content = "Article n°{i} -- {text}"`` (``i`` = the row's
    stable id) and ``metadata`` = JSON of the row's metadata columns.  A null text is empty."""
    return df.select("*", F.format_string(ARTICLE_FORMAT, F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).alias("page_content"),
                     F.to_json(F.struct(*meta_cols)).alias("metadata"))


# ---- WIN-7 / SUM-3: greedy packing ------------------------------------------

def pack_windows(df: DataFrame, group: list[str], order: str, tokens_col: str, limit: int,
                 overhead: int = 0, sep_tokens: int = 0) -> DataFrame:
    """Consecutive documents (by ``order``) packed greedily: a document starts a
    new window iff the window is non-empty and ``overhead + used + sep + t >
    limit``; an oversize document stands alone.  Adds ``window`` (0-based).
    One path for every size: ``sequence.greedy_windows`` never holds a group in
    one task; null groups are groups, and no row is lost or doubled."""
    return greedy_windows(df, group, order, tokens_col, limit, overhead, sep_tokens)


def window_prompts(docs: DataFrame, group: list[str], order: str, content_col: str,
                   template: str, variable: str, sep: str = PARAGRAPH_SEP,
                   window_col: str = "window") -> DataFrame:
    """SUM-1: per (group, window) the documents joined by ``sep`` in order and
    filled into ``template`` at ``{variable}``."""
    g = docs.groupBy(*group, window_col).agg(
        F.count("*").alias("n_docs"),
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(content_col).alias("c")))).alias("_l"))
    body = F.array_join(F.transform("_l", lambda s: s["c"]), sep)
    return g.select(*group, window_col, "n_docs", fill_template(template, **{variable: body}).alias("prompt"))


# ---- GEN-1: batch generation -------------------------------------------------

# How the default summariser reads a text (the common subset of Java regex and RE2).
SENTENCE_END, WORD, BLANKS = r"([.!?])[ \t\n\r\f]+", r"[\p{L}\p{N}]+", r"^[ \t\n\r\f]+|[ \t\n\r\f]+$"


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _sentence_scores(words: pd.Series) -> pd.Series:
    """Summed TF-IDF of every sentence of each prompt, from the sentences' words (64-bit hashes)."""
    out = []
    for sents in words:
        flat = np.concatenate([np.zeros(0, np.int64), *sents]).astype(np.int64)
        known, at = np.unique(flat, return_inverse=True)
        key, tf = np.unique(np.repeat(np.arange(len(sents)), [len(x) for x in sents]) * max(1, known.size) + at, return_counts=True)
        pos, w = np.divmod(key, max(1, known.size))
        out.append(np.bincount(pos, tf * np.log(len(sents) / np.bincount(w, minlength=known.size)[w]), len(sents)))
    return pd.Series(out, dtype=object)


class Extractive:
    """The default generator, a relation instead of a batch function: the ``max_sentences`` sentences of each prompt with
    the largest summed TF-IDF (IDF over the sentences of that prompt, sums rounded to 9 decimals, ties to the earlier
    sentence), in their order.  The template's fixed text is dropped first.  A prompt is bounded by its token limit and
    scored where it lies: nothing is shuffled.  ``max_words`` is the caller's output budget."""

    def __init__(self, template: str | None = None, max_sentences: int = 3, max_words: int | None = None):
        self.fixed = [p for p in re.split(r"\{\w+\}", template or "") if p.strip()]
        self.max_sentences, self.max_words = max_sentences, max_words

    def sentences(self, prompt) -> Column:
        body = F.coalesce(prompt, F.lit(""))
        for part in self.fixed:
            body = F.replace(body, F.lit(part), F.lit("\n"))
        lines = F.split(F.regexp_replace(body, SENTENCE_END, "$1\n"), "\n", -1)
        return F.filter(F.transform(lines, lambda x: F.regexp_replace(x, BLANKS, "")), lambda x: x != "")

    def column(self, df: DataFrame, prompt_col: str, out_col: str) -> DataFrame:
        said = df.withColumn("__sents", self.sentences(F.col(prompt_col)))
        words = F.transform("__sents", lambda s: F.transform(F.regexp_extract_all(F.lower(s), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)))
        scored = said.withColumn("__score", _sentence_scores(words))
        ranked = F.array_sort(F.transform("__score", lambda s, i: F.struct((-F.round(s, 9)).alias("s"), i.alias("pos"))))
        best = F.array_sort(F.transform(F.slice(ranked, 1, self.max_sentences), lambda r: r["pos"]))
        out = scored.withColumn("__at", best)
        text = F.array_join(F.transform("__at", lambda i: F.get("__sents", i)), " ")
        if self.max_words is not None:
            text = F.array_join(F.slice(F.split(text, " ", -1), 1, self.max_words), " ")
        return out.withColumn(out_col, F.coalesce(text, F.lit(""))).drop("__score", "__at", "__sents")


def extractive_generator(template: str | None = None, max_sentences: int = 3, max_words: int | None = None) -> Extractive:
    """Default ``generate``: drops the template's fixed text, then summarises."""
    return Extractive(template, max_sentences, max_words)


def generate_column(df: DataFrame, prompt_col: str, fn=None, out_col: str = "generated",
                    **params) -> DataFrame:
    """GEN-1: ``fn(list_of_prompts, **params) -> list_of_texts`` per Arrow batch, or an ``Extractive`` (the default)."""
    fn = fn or extractive_generator()
    if isinstance(fn, Extractive):
        return fn.column(df, prompt_col, out_col)
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.StringType())])

    def run(batches):
        for pdf in batches:
            res = fn(pdf[prompt_col].fillna("").tolist(), **params) if len(pdf) else []
            yield pdf.assign(**{out_col: pd.Series(list(res), index=pdf.index, dtype=object)})
    return df.mapInPandas(run, schema)


# ---- SUM-4 / SUM-6: recursive summarisation --------------------------------

def recursive_summary(docs: DataFrame, group: list[str], order: str, content_col: str,
                      generate=None, template: str = STUFF_TEMPLATE, variable: str = "text",
                      limit: int = STUFF_LIMIT, mode="regex") -> DataFrame:
    """Summarise each group: if all its documents fit one prompt, generate once;
    otherwise pack windows, summarise each window and recurse on the
    summaries.  All groups and windows of a level run in the same jobs;
    finished groups leave the loop; a level that does not reduce a group's
    document count stops that group (the reference would recurse forever), so
    the loop ends with every group in the result.  Nothing about groups passes
    through the driver.  Returns ``(group…, summary, levels)``."""
    generate = generate or extractive_generator(template)
    overhead = template_overhead(template, mode)
    cur = numbered(docs.select(*group, F.col(order).alias("_key"), F.coalesce(content_col, F.lit("")).alias("_c")),
                   [*group, "_key"], "_o").drop("_key").withColumn("_before", F.lit(None).cast("long"))
    finished: DataFrame | None = None
    level = 0
    while True:
        level += 1
        cur = cur.withColumn("_t", token_count(F.col("_c"), mode))
        packed = cut_lineage(pack_windows(cur, group, "_o", "_t", limit, overhead, 0))
        prompts = window_prompts(packed, group, "_o", "_c", template, variable, window_col="window")
        stats = packed.groupBy(*group).agg((F.max("window") + 1).alias("_nw"), F.count("*").alias("_nd"),
                                           F.max("_before").alias("_before"))
        gen = cut_lineage(generate_column(null_safe_join(prompts, stats, group), "prompt", generate, "_s"))
        # one window: its summary is the answer; as many documents as a level before: no progress
        over = (F.col("_nw") == 1) | F.coalesce(F.col("_nd") >= F.col("_before"), F.lit(False))
        done = gen.where(over).groupBy(*group).agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("window", "_s"))),
                                     lambda s: s["_s"]), PARAGRAPH_SEP).alias("summary")) \
            .withColumn("levels", F.lit(level))
        finished = done if finished is None else finished.unionByName(done)
        cur = gen.where(~over).select(*group, F.col("window").cast("long").alias("_o"), F.col("_s").alias("_c"),
                                      F.col("_nd").alias("_before"))
        if cur.isEmpty():
            return finished


# ---- SUM-5: map-reduce summarisation ----------------------------------------

def map_reduce_summary(docs: DataFrame, group: list[str], order: str, content_col: str,
                       generate_map=None, generate_reduce=None, chunk_tokens: int = 1000,
                       token_max: int = REDUCE_TOKEN_MAX, mode="regex",
                       map_template: str = MAP_TEMPLATE, map_variable: str = "docs",
                       reduce_template: str = REDUCE_TEMPLATE, reduce_variable: str = "doc_summaries") -> DataFrame:
    """Chunk every document (TXT-2), summarise each chunk with the map prompt,
    collapse summaries in packed groups of at most ``token_max`` tokens with
    the reduce prompt until a group's summaries fit (or no longer shrink), then
    reduce once more.  Groups are compared with their state of the level before
    inside Spark; nothing about them passes through the driver."""
    from quarry.operators.chunking import counted_chunks, token_chunks
    gm = generate_map or extractive_generator(map_template)
    gr = generate_reduce or extractive_generator(reduce_template)
    d = docs.select(*group, F.col(order).alias("_doc"), F.col(content_col).alias("_text"))
    d = counted_chunks(d, "_text", chunk_tokens, mode) if callable(mode) else \
        d.withColumn("_chunks", token_chunks("_text", chunk_tokens, mode=mode))
    ch = d.select(*group, "_doc", F.posexplode_outer("_chunks").alias("_i", "_c"))
    ch = numbered(ch.select(*group, "_doc", F.coalesce("_i", F.lit(0)).alias("_i"), F.coalesce("_c", F.lit("")).alias("_c")),
                  [*group, "_doc", "_i"], "_o").drop("_doc", "_i")
    none = F.lit(None).cast("long")
    cur = cut_lineage(generate_column(ch.withColumn("prompt", fill_template(map_template, **{map_variable: F.col("_c")})),
                                      "prompt", gm, "_s").select(*group, "_o", F.col("_s").alias("_c"),
                                                                 none.alias("_pn"), none.alias("_pt")))
    while True:
        cur = cur.withColumn("_t", token_count(F.col("_c"), mode))
        state = cur.groupBy(*group).agg(F.sum("_t").alias("_tok"), F.count("*").alias("_n"),
                                        F.max("_pn").alias("_bn"), F.max("_pt").alias("_bt"))
        moved = ~(F.col("_n").eqNullSafe(F.col("_bn")) & F.col("_tok").eqNullSafe(F.col("_bt")))
        state = state.withColumn("_todo", (F.col("_tok") > token_max) & (F.col("_n") > 1) & moved)
        cur = cut_lineage(null_safe_join(cur.drop("_pn", "_pt"), state.select(*group, "_todo", "_n", "_tok"), group))
        todo = cur.where("_todo")
        if todo.isEmpty():
            break
        packed = pack_windows(todo.drop("_todo"), group, "_o", "_t", token_max, 0, 0)
        before = packed.groupBy(*group).agg(F.max("_n").alias("_pn"), F.max("_tok").alias("_pt"))
        prompts = window_prompts(packed, group, "_o", "_c", reduce_template, reduce_variable)
        coll = generate_column(null_safe_join(prompts, before, group), "prompt", gr, "_s").select(
            *group, F.col("window").cast("long").alias("_o"), F.col("_s").alias("_c"), "_pn", "_pt")
        keep = cur.where("NOT _todo").select(*group, "_o", "_c", F.col("_n").alias("_pn"), F.col("_tok").alias("_pt"))
        cur = cut_lineage(keep.unionByName(coll))
    final = window_prompts(cur.withColumn("window", F.lit(0)), group, "_o", "_c", reduce_template, reduce_variable)
    return generate_column(final, "prompt", gr, "summary").select(*group, "n_docs", "summary")
