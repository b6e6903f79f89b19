"""Document chunking (TXT-1..4, WIN-2, FN-6, UDF-5).

Three modes, all row-local and native (a document is the unit, nothing is shuffled):

* ``window``    fixed stride, fully native:
                ``transform(sequence(0, len-overlap-1, size-overlap), s -> substring(...))``;
* ``tokens``    paragraphs (split on a separator) packed greedily up to a token
                budget, native ``aggregate`` fold (TXT-2);
* ``recursive`` coarse-to-fine separators with overlap (TXT-1), native: one
                pass per separator, then a fold over the pieces' lengths.

``explode_chunks`` turns the arrays into a chunk table with ``split_idx`` and
``chunk_id = {key}_split-{idx}``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import PARAGRAPH_SEP, chunk_id, token_count
from quarry.operators.sequence import greedy_windows
from quarry.session import cut_lineage

# The recursive splitter's defaults.
RECURSIVE_SEPARATORS = ("\n\n", "\n", " ", "")
CHUNK_SIZE = 600
CHUNK_OVERLAP = 100


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def window_chunks(text, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Fixed-stride windows of ``size`` characters overlapping by ``overlap``.
    Empty or null text gives no chunk; 600 chars one; 601 chars two."""
    t = F.coalesce(_c(text), F.lit(""))
    n = F.length(t)
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(
        F.transform(starts, lambda s: F.substring(t, s + 1, size)))


def stripped_pieces(text, separator: str = PARAGRAPH_SEP) -> Column:
    """Non-empty pieces between separators, without white space at their ends."""
    if separator.strip():
        raise ValueError("token chunks need a whitespace separator (additive token counts)")
    return F.filter(F.transform(F.split(_c(text), re.escape(separator), -1),
                                lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")),
                    lambda p: p != "")


def counted_chunks(df: DataFrame, text_col: str, max_tokens: int, counter, separator: str = PARAGRAPH_SEP) -> DataFrame:
    """TXT-2 / UDF-4 with any counter, pandas UDFs included: adds ``_chunks`` like ``token_chunks``.  Pieces are rows:
    counted once, packed by ``greedy_windows`` per document and joined again in order."""
    rows = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))
    pieces = rows.select("_row", F.posexplode(stripped_pieces(text_col, separator)).alias("_at", "_piece"))
    packed = greedy_windows(pieces.withColumn("_n", token_count("_piece", counter)), ["_row"], "_at", "_n", max_tokens)
    chunks = packed.groupBy("_row", "window").agg(F.array_sort(F.collect_list(F.struct("_at", "_piece"))).alias("_l")) \
        .select("_row", "window", F.array_join(F.transform("_l", lambda x: x["_piece"]), separator).alias("_c")) \
        .groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("window", "_c"))).alias("_l")) \
        .select("_row", F.transform("_l", lambda x: x["_c"]).alias("_chunks"))
    return rows.join(chunks, "_row", "left").withColumn("_chunks", F.coalesce("_chunks", F.array().cast("array<string>"))).drop("_row")


def token_chunks(text, max_tokens: int = 1000, separator: str = PARAGRAPH_SEP,
                 mode="regex") -> Column:
    """TXT-2: split on ``separator``; pack consecutive pieces while the token
    count of the joined chunk stays <= ``max_tokens`` (a piece larger than the
    budget stands alone); strip; drop empty pieces.  The counter is additive
    over whitespace separators, so the fold only adds counts.  A counter that is a
    Python UDF needs ``counted_chunks``: Spark has no UDF inside a fold."""
    pieces = stripped_pieces(text, separator)
    init = F.struct(F.array().cast("array<string>").alias("done"),
                    F.lit(None).cast("string").alias("cur"), F.lit(0).alias("n"))

    def step(acc, p):
        t = token_count(p, mode)
        start_new = acc["cur"].isNotNull() & (acc["n"] + t > max_tokens)
        return F.when(acc["cur"].isNull(), F.struct(acc["done"].alias("done"), p.alias("cur"), t.alias("n"))) \
            .when(start_new, F.struct(F.array_append(acc["done"], acc["cur"]).alias("done"),
                                      p.alias("cur"), t.alias("n"))) \
            .otherwise(F.struct(acc["done"].alias("done"),
                                F.concat(acc["cur"], F.lit(separator), p).alias("cur"),
                                (acc["n"] + t).alias("n")))

    return F.aggregate(pieces, init, step,
                       lambda acc: F.when(acc["cur"].isNull(), acc["done"])
                       .otherwise(F.array_append(acc["done"], acc["cur"])))


# ---- recursive splitter -----------------------------------------------------------------------

_LEAF = "array<struct<s: string, n: int, first: boolean>>"


def recursive_leaves(text, size: int = CHUNK_SIZE, separators=RECURSIVE_SEPARATORS) -> Column:
    """Pieces of a text, in order and without gaps, as structs (s, n, first): n characters; s is the text of a piece
    that is still to be cut (null: done); ``first`` starts a run of pieces that may be merged.

    One pass per separator, coarse to fine: a piece that is to be cut and holds the separator falls into the part
    before its first occurrence and one piece from each occurrence on; of these, pieces of ``size`` characters or
    more go on to the finer separators.  A long piece ends a run, and so does the end of the piece that was cut.
    The empty separator cuts into single characters."""
    t = F.coalesce(_c(text), F.lit(""))
    level = F.array(F.struct(t.alias("s"), F.length(t).alias("n"), F.lit(True).alias("first"))).cast(_LEAF)
    for sep in separators:
        def cut(x):
            if sep == "":
                letters = F.transform(F.sequence(F.lit(1), F.greatest(x["n"], F.lit(1))), lambda i: F.struct(
                    F.lit(None).cast("string").alias("s"), F.lit(1).alias("n"), (i == 1).alias("first")))
                return F.when(x["s"].isNotNull(), F.when(x["n"] > 0, letters).otherwise(F.array().cast(_LEAF))).otherwise(F.array(x))
            parts = F.filter(F.transform(F.split(x["s"], re.escape(sep), -1),
                                         lambda p, i: F.when(i > 0, F.concat(F.lit(sep), p)).otherwise(p)), lambda p: p != "")
            # the list of parts is bound once (an array of one list), so that a part can look at the one before it
            pieces = F.flatten(F.transform(F.array(parts), lambda ps: F.transform(ps, lambda p, i: F.struct(
                F.when(F.length(p) >= size, p).alias("s"), F.length(p).alias("n"),
                ((i == 0) | (F.length(F.get(ps, i - 1)) >= size)).alias("first")))))
            return F.when(x["s"].contains(sep), pieces).otherwise(F.array(x))
        level = F.flatten(F.transform(level, cut))
    return level


def recursive_spans(leaves, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Chunks as (a, b) offsets: one fold over the pieces' lengths.  The state is the offsets at which the pieces of
    the open chunk start and the offset reached; a piece that would make the chunk longer than ``size`` closes it, and
    the next one begins with the longest tail of at most ``overlap`` characters that leaves room for that piece."""
    span = "array<struct<a: int, b: int>>"
    none = F.array().cast("array<int>")
    start = F.struct(F.array().cast(span).alias("out"), none.alias("at"), F.lit(0).alias("b"))

    def closed(acc):
        return F.when(F.size(acc["at"]) > 0, F.array_append(acc["out"], F.struct(F.get(acc["at"], 0).alias("a"), acc["b"].alias("b")))) \
            .otherwise(acc["out"])

    def step(acc, x):
        full = (F.size(acc["at"]) > 0) & (acc["b"] - F.get(acc["at"], 0) + x["n"] > size)
        tail = F.filter(acc["at"], lambda s: (acc["b"] - s <= overlap) & (acc["b"] - s + x["n"] <= size))
        kept = F.when(x["first"], none).when(full, tail).otherwise(acc["at"])
        return F.struct(F.when(x["first"] | full, closed(acc)).otherwise(acc["out"]).alias("out"),
                        F.array_append(kept, acc["b"]).alias("at"), (acc["b"] + x["n"]).alias("b"))

    return F.aggregate(leaves, start, step, closed)


def recursive_chunks(text, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """TXT-1: chunks of at most ``size`` characters cut at the coarsest separator that does, neighbours overlapping by
    at most ``overlap``, without white space at their ends; empty ones are dropped.  Built-in expressions only."""
    t = F.coalesce(_c(text), F.lit(""))
    spans = recursive_spans(recursive_leaves(t, size), size, overlap)
    chunks = F.transform(spans, lambda c: F.regexp_replace(t.substr(c["a"] + 1, c["b"] - c["a"]), r"^\s+|\s+$", ""))
    return F.filter(chunks, lambda c: c != "")


def chunk(df: DataFrame, text_col: str, key_col: str, mode: str = "recursive", **kw) -> DataFrame:
    """TXT-1/2/3 + WIN-2: one row per chunk with ``split_idx``, ``chunk_id`` and
    ``chunk`` (all other columns are copied to every chunk).  ``mode="none"``
    keeps one row per document with ``chunk_id = key`` (TXT-3); ``mode="tokens"``
    takes the caller's ``counter`` (a function of a column, UDF-4)."""
    if mode == "none":
        return df.withColumn("split_idx", F.lit(0)).withColumn("chunk_id", F.col(key_col).cast("string")) \
            .withColumn("chunk", F.col(text_col))
    if mode == "tokens" and callable(kw.get("counter")):
        return explode_chunks(counted_chunks(df, text_col, kw.get("max_tokens", 1000), kw["counter"],
                                             kw.get("separator", PARAGRAPH_SEP)), key_col)
    arr = {"window": window_chunks, "tokens": token_chunks, "recursive": recursive_chunks}[mode](text_col, **kw)
    return explode_chunks(df.withColumn("_chunks", arr), key_col)


def explode_chunks(df: DataFrame, key_col: str, arr_col: str = "_chunks") -> DataFrame:
    others = [c for c in df.columns if c != arr_col]
    e = df.select(*others, F.posexplode(arr_col).alias("split_idx", "chunk"))
    return e.withColumn("chunk_id", chunk_id(F.col(key_col), F.col("split_idx")))
