"""Bounded, reproducible samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null ids: fold of the empty string)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, max_rows: int,
                    per_class: bool = False) -> DataFrame:
    """(doc_id, text, y) of at most ``max_rows`` labelled ids (of each class if ``per_class``): the
    ones with the smallest hash among rows that ``keep`` admits.  Ids are chosen from the labels
    alone and broadcast (their number is the bound), so no text is shuffled to find them.  An id
    labelled twice gets its larger label; of rows that repeat an id the first text counts."""
    lab = labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("y")) \
        .where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & keep).groupBy("doc_id").agg(F.max("y").alias("y"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    if per_class:
        ids = lab.where("y = 0").orderBy(*order).limit(max_rows).unionByName(
            lab.where("y = 1").orderBy(*order).limit(max_rows))
    else:
        ids = lab.orderBy(*order).limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
