"""Retrieval and retrieval-augmented prompts (VEC-2, RAG-1/2).

A batch of questions is answered in one job: exact top-k retrieval
(``similarity_search``, questions broadcast in size-checked batches), the
retrieved texts are joined back by id and concatenated per question in rank
order (at most ``k`` texts, so the group is bounded), the template is filled
and the generator runs over the prompt column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import PARAGRAPH_SEP, fill_template
from quarry.operators.chunking import chunk
from quarry.operators.embed import add_hashed_terms, fit_hashed_terms
from quarry.operators.extract import extract_articles
from quarry.operators.summarize import RAG_TEMPLATE, generate_column
from quarry.operators.vector import similarity_search
from quarry.session import cut_lineage
from quarry.sources.sinks import write_vector_table


def retrieve(docs: DataFrame, questions: DataFrame, k: int = 4, *, doc_id: str, doc_vec: str,
             question_id: str, question_vec: str, metric: str = "l2sq") -> DataFrame:
    """VEC-2: ``(question_id, rank, doc_id, distance, <doc columns>)``."""
    hits = similarity_search(docs.select(doc_id, doc_vec), questions, k, id_col=doc_id, vec_col=doc_vec,
                             query_id_col=question_id, query_vec_col=question_vec, metric=metric)
    return hits.join(docs.drop(doc_vec), doc_id)


def rag_prompts(docs: DataFrame, questions: DataFrame, k: int = 4, *, doc_id: str, doc_vec: str,
                doc_text: str, question_id: str, question_text: str, question_vec: str,
                template: str = RAG_TEMPLATE, metric: str = "l2sq") -> DataFrame:
    """RAG-1/2: ``(question_id, question, doc_ids, prompt)``.  Only the question
    columns named here are read; any other columns of ``questions`` are ignored."""
    q = questions.select(question_id, question_text, question_vec)
    hits = retrieve(docs, q.select(question_id, question_vec), k, doc_id=doc_id, doc_vec=doc_vec,
                    question_id=question_id, question_vec=question_vec, metric=metric)
    ctx = hits.groupBy(question_id).agg(
        F.array_sort(F.collect_list(F.struct("rank", F.col(doc_id).alias("_id"), F.col(doc_text).alias("_t"))))
        .alias("_l"))
    ctx = ctx.select(question_id, F.transform("_l", lambda s: s["_id"]).alias("doc_ids"),
                     F.array_join(F.transform("_l", lambda s: s["_t"]), PARAGRAPH_SEP).alias("_ctx"))
    j = q.drop(question_vec).join(ctx, question_id)
    return j.select(question_id, F.col(question_text).alias("question"), "doc_ids",
                    fill_template(template, context=F.col("_ctx"), question=F.col(question_text)).alias("prompt"))


def answer(prompts: DataFrame, generate=None, prompt_col: str = "prompt") -> DataFrame:
    """RAG-1 final step: generator over the prompt column (``answer`` column)."""
    return generate_column(prompts, prompt_col, generate, "answer")


def index_texts(docs: DataFrame, id_col: str, text_col: str, *, dim: int = 256, mode: str = "window",
                vector_scope: str = "chunk") -> DataFrame:
    """TXT-4: ``(id, <other columns>, text, split_idx, vector)``, one row per chunk.  With
    ``vector_scope="document"`` every chunk carries the vector of its whole document."""
    if vector_scope not in ("chunk", "document"):
        raise ValueError(f"vector_scope is 'chunk' or 'document', not {vector_scope!r}")
    if vector_scope == "document":
        docs = add_hashed_terms(docs, text_col, fit_hashed_terms(docs, id_col, text_col, dim), dim)
    c = chunk(docs, text_col, id_col, mode=mode).drop(text_col)
    if vector_scope == "chunk":
        c = add_hashed_terms(c, "chunk", fit_hashed_terms(c, "chunk_id", "chunk", dim), dim)
    others = [x for x in docs.columns if x not in (text_col, "vector")]
    return c.select(F.col("chunk_id").alias("id"), *others, F.col("chunk").alias("text"), "split_idx", "vector")


def index_pages(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url",
                html_col: str = "html", dim: int = 256, min_pages: int | None = 3) -> DataFrame:
    """SRC-11 / VEC-4: extract the articles, cut them in chunks, embed these, write the table partitioned
    by host and return it as read back.  Pages without text have no entry."""
    docs = cut_lineage(extract_articles(pages, id_col, url_col, html_col, min_pages).where("full_text IS NOT NULL")
                       .select(id_col, url_col, "host", "title", "full_text"))
    write_vector_table(index_texts(docs, id_col, "full_text", dim=dim), path, ["host"])
    return pages.sparkSession.read.parquet(path)
