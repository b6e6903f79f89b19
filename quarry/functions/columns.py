"""Column selection and nested access helpers (PRJ-3, PRJ-6, FN-17)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def columns_like(df: DataFrame, pattern: str) -> DataFrame:
    """PRJ-3: the columns whose name contains ``pattern`` (e.g. ``"umap_"``), in order."""
    return df.select(*[c for c in df.columns if pattern in c])


def columns_matching(df: DataFrame, regex: str) -> DataFrame:
    """PRJ-3 with a regular expression over the column names."""
    rx = re.compile(regex)
    return df.select(*[c for c in df.columns if rx.search(c)])


def row_as_json(*cols: str) -> Column:
    """FN-17: row -> map-like JSON object of the named columns."""
    return F.to_json(F.struct(*cols))


def map_entries_rows(df: DataFrame, map_col: str, key: str = "key", value: str = "value") -> DataFrame:
    """FN-17: map -> rows."""
    others = [c for c in df.columns if c != map_col]
    return df.select(*others, F.explode(map_col).alias(key, value))
