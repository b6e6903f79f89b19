"""Column expressions over ``ARRAY<FLOAT|DOUBLE>`` vectors.

All arithmetic is done in DOUBLE (embeddings are stored as FLOAT), so Spark
and the DuckDB oracles agree to the last rounded digit.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v) -> Column:
    return F.transform(_c(v), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y),
                       F.lit(0.0), lambda acc, x: acc + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(v) -> Column:
    """FN-12: unit length; the zero vector stays zero."""
    n = norm(v)
    return F.when(n == 0, as_double(v)).otherwise(F.transform(as_double(v), lambda x: x / n))


def sq_l2(a, b) -> Column:
    """Squared Euclidean distance (the vector store's ``_distance``)."""
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)),
                       F.lit(0.0), lambda acc, x: acc + x)


def l2(a, b) -> Column:
    return F.sqrt(sq_l2(a, b))


def cosine_distance(a, b) -> Column:
    return F.lit(1.0) - dot(a, b) / (norm(a) * norm(b))


def mean_vector(v) -> Column:
    """Element-wise mean as an aggregate (map-side partial via Summarizer)."""
    return vector_to_array(Summarizer.mean(array_to_vector(as_double(v))))


def component(v, i: int) -> Column:
    """0-based component as DOUBLE."""
    return _c(v).getItem(i).cast("double")
