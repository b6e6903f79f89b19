"""Relational corpus operators (WIN-1..6, SRT-1/2, LIM-1..4, SET-1..3, JOI-1..3).

Keyed de-duplication and first-match lookups are aggregations (``max_by`` /
``min_by``), not windows: they combine map-side before the shuffle, so a key
holding a third of all rows costs one partial row per task instead of a
third of the table in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(cs) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def keep_last(df: DataFrame, key: list[str], seq: list[str], keep_first_seq: bool = True) -> DataFrame:
    """WIN-1 / SET-2: one row per key, the one with the greatest ``seq``
    (dict overwrite = last wins).  ``first_seq`` keeps the position of the
    key's first occurrence (dict insertion order)."""
    others = [c for c in df.columns if c not in key]
    s = F.struct(*_cols(seq))
    aggs = [F.max_by(F.struct(*_cols(others)), s).alias("_r")]
    if keep_first_seq:
        aggs.append(F.min(s).alias("_first"))
    g = df.groupBy(*key).agg(*aggs)
    out = [*key, *[F.col("_r")[c].alias(c) for c in others]]
    if keep_first_seq:
        out += [F.col("_first")[c].alias(f"first_{c}") for c in seq]
    return g.select(*out)


def keep_first(df: DataFrame, key: list[str], seq: list[str]) -> DataFrame:
    """First-wins variant (the streaming de-duplication semantics)."""
    others = [c for c in df.columns if c not in key]
    g = df.groupBy(*key).agg(F.min_by(F.struct(*_cols(others)), F.struct(*_cols(seq))).alias("_r"))
    return g.select(*key, *[F.col("_r")[c].alias(c) for c in others])


def top_n_per_group(df: DataFrame, group: list[str], order: list[Column], n: int,
                    rank_col: str = "rank") -> DataFrame:
    """SRT-1 / SRC-5 / WIN-3: best ``n`` rows per group.  ``row_number() <= n``
    is planned as a partial WindowGroupLimit before the exchange."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def paged(df: DataFrame, order: list[Column], page_size: int = 20, max_results: int = 100,
          total: int | None = None) -> DataFrame:
    """WIN-6 / LIM-2: the first ``min(total, max_results)`` rows in ``order``
    with ``page`` (1-based) and ``pos`` columns.  The global order is a
    distributed top-k (TakeOrderedAndProject); numbering touches ≤ max rows."""
    cap = max_results if total is None else min(total, max_results)
    top = df.orderBy(*order).limit(cap)
    w = Window.orderBy(*order)
    return (top.withColumn("pos", F.row_number().over(w))
            .withColumn("page", F.ceil(F.col("pos") / F.lit(page_size)).cast("int")))


def offset_limit(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """LIM-1: ``start`` / ``max_results``."""
    return df.orderBy(*order).offset(offset).limit(limit)


def union_all(*dfs: DataFrame) -> DataFrame:
    """SET-1: bag union by name; missing columns become NULL."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def first_match_lookup(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """JOI-2: ``key -> value`` of the first row (by ``order``) with that key."""
    return df.groupBy(key).agg(F.min_by(F.col(value), F.struct(*_cols(order))).alias(value))


def left_enrich(df: DataFrame, lookup: DataFrame, on: list[str]) -> DataFrame:
    """JOI-3: left equi-join; unmatched rows keep NULL in the new columns."""
    return df.join(lookup, on, "left")


def attach_one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """JOI-1: positional concat re-expressed as an inner join on the id.

    1:1 is a contract of the inputs; ``check_one_to_one`` verifies it.
    """
    return left.join(right, key, "inner")


def check_one_to_one(left: DataFrame, right: DataFrame, key: str) -> None:
    nl, nr = left.count(), right.count()
    nj = left.join(right, key, "inner").count()
    if not (nl == nr == nj):
        raise ValueError(f"not 1:1 on {key}: left {nl}, right {nr}, joined {nj}")


def skew_join(rows: DataFrame, unique: DataFrame, keys: list[str], how: str = "inner", share: int = 1000,
              at_most: int | None = None) -> DataFrame:
    """``rows`` joined to ``unique`` (one row per key), balanced when a few keys hold most rows: keys of more than
    ``1 / share`` of the rows, of which there are fewer than ``share``, join by a broadcast of their rows of ``unique``,
    the others by a shuffle.  Null keys match nothing (``how="left"`` keeps their rows).  ``at_most``: a bound of the
    number of rows, if the caller knows one; up to 100 rows a key no key counts as hot and the rows are not counted."""
    total = rows.count() if at_most is None or at_most > 100 * share else at_most
    if total <= 100 * share:
        return rows.join(unique, keys, how)
    hot = rows.groupBy(*keys).count().where(F.col("count") * share > total).select(*keys)
    hot_keys = hot.collect()
    if not hot_keys:
        return rows.join(unique, keys, how)
    hot = F.broadcast(rows.sparkSession.createDataFrame(hot_keys, hot.schema))
    cold_side = rows.join(hot, keys, "left_anti").join(unique, keys, how)
    hot_side = rows.join(hot, keys, "left_semi").join(F.broadcast(unique.join(hot, keys, "left_semi")), keys, how)
    return cold_side.unionByName(hot_side)
