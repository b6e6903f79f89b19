"""Field-scoped boolean keyword predicates (FIL-1) and relevancy (SRT-2).

Predicates are built with functions and operators, ``term("title", "deep") &
~term("all", "survey")``; there is no query-string grammar.  Each text field
is tokenised once per row and every named predicate of a search is evaluated
in the same scan, so N queries cost one pass over the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import word_tokens


class Pred:
    def __and__(self, other: "Pred") -> "Pred":
        return _Bin("and", self, other)

    def __or__(self, other: "Pred") -> "Pred":
        return _Bin("or", self, other)

    def __invert__(self) -> "Pred":
        return _Not(self)

    def column(self, toks: dict[str, Column]) -> Column:
        raise NotImplementedError

    def terms(self) -> set[tuple[str, str]]:
        raise NotImplementedError


@dataclass(frozen=True)
class _Term(Pred):
    field: str
    word: str

    def column(self, toks):
        fields = list(toks) if self.field == "all" else [self.field]
        cond = F.lit(False)
        for f in fields:
            cond = cond | F.array_contains(toks[f], self.word)
        return cond

    def terms(self):
        return {(self.field, self.word)}


@dataclass(frozen=True)
class _Bin(Pred):
    op: str
    a: Pred
    b: Pred

    def column(self, toks):
        x, y = self.a.column(toks), self.b.column(toks)
        return (x & y) if self.op == "and" else (x | y)

    def terms(self):
        return self.a.terms() | self.b.terms()


@dataclass(frozen=True)
class _Not(Pred):
    a: Pred

    def column(self, toks):
        return ~self.a.column(toks)

    def terms(self):
        return set()


def _in_words(words: list[str]):
    return lambda x: x.isin(words)


def term(field: str, word: str) -> Pred:
    """``field`` is a text column name or ``"all"`` (any field)."""
    return _Term(field, word.lower())


def keyword_search(df: DataFrame, fields: dict[str, Column | str], queries: dict[str, Pred],
                   id_col: str, top_n: int | None = None) -> DataFrame:
    """Rows ``(query_id, id, hits, n_tokens, score[, rank])`` for every match.

    ``hits`` = tokens of the searched fields equal to a positive term of the
    query; ``score = hits / n_tokens`` (relevancy).  With ``top_n`` the best
    ``top_n`` per query by (score desc, id) are kept — a grouped limit that
    Spark applies partially before the shuffle (WindowGroupLimit).
    """
    toks = {f: word_tokens(F.col(c) if isinstance(c, str) else c) for f, c in fields.items()}
    base = df.select(F.col(id_col), *[toks[f].alias(f"_t_{f}") for f in toks])
    tcols = {f: F.col(f"_t_{f}") for f in toks}
    matched = F.filter(F.array(*[F.when(p.column(tcols), F.lit(q)) for q, p in queries.items()]),
                       lambda x: x.isNotNull())
    hits_by_query = {}
    for q, p in queries.items():
        h = F.lit(0)
        for f in toks:
            words = sorted({w for (ff, w) in p.terms() if ff in (f, "all")})
            if words:
                h = h + F.size(F.filter(tcols[f], _in_words(words)))
        hits_by_query[q] = h
    n_tok = sum((F.size(F.filter(tcols[f], lambda x: x != "")) for f in toks), F.lit(0))
    hits = F.lit(None).cast("int")                   # only the matched query's hits are counted
    for q in reversed(list(queries)):
        hits = F.when(F.col("query_id") == q, hits_by_query[q]).otherwise(hits)
    out = (base.select(id_col, F.explode(matched).alias("query_id"), n_tok.alias("n_tokens"),
                       *[F.col(f"_t_{f}") for f in toks])
           .withColumn("hits", hits)
           .select("query_id", id_col, "hits", "n_tokens",
                   F.when(F.col("n_tokens") > 0, F.col("hits") / F.col("n_tokens")).otherwise(0.0)
                   .alias("score")))
    if top_n is not None:
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col(id_col))
        out = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
    return out


SORTS = ("relevancy", "popularity", "publishedAt")


def sorted_search(df: DataFrame, fields: dict[str, Column | str], queries: dict[str, Pred], id_col: str,
                  sort_by: str, top_n: int, *, date_col: str | None = None, source_col: str | None = None) -> DataFrame:
    """SRT-2: the ``top_n`` matches of each query by the chosen order: ``relevancy`` (score), ``popularity``
    (articles of the same source, most first) or ``publishedAt`` (newest first); ties by id."""
    if sort_by not in SORTS:
        raise ValueError(f"sort_by must be one of {SORTS}, not {sort_by!r}")
    hits = keyword_search(df, fields, queries, id_col)
    if sort_by == "relevancy":
        key = F.col("score")
    elif sort_by == "publishedAt":
        hits = hits.join(df.select(id_col, F.col(date_col).alias("_key")), id_col)
        key = F.col("_key")
    else:
        size = df.groupBy(source_col).agg(F.count("*").alias("_key"))
        hits = hits.join(df.select(id_col, source_col), id_col).join(size, source_col)
        key = F.col("_key")
    w = Window.partitionBy("query_id").orderBy(key.desc_nulls_last(), F.col(id_col))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n).select("query_id", "rank", id_col)
