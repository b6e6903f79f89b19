"""Whitening of embeddings by the weighted covariance of their distinct grid vectors.

Entries become integers on a grid, ``x = floor(scale * c) + offset``; rows with equal ``x``
form one distinct vector with a multiplicity.  Weights are the multiplicities (``counts``:
the fit list is every row) or 1 (``one``: the fit list is every distinct vector).

1. ``grid_vectors``   distinct vectors with multiplicities, keyed by a SHA-256 of ``x``
2. ``moments``        exact n and per-dimension sums S (decimal sums)
3. ``covariance``     weighted GEMM of ``x - S/n`` per task, d rows of d per task summed by row number
4. ``components``     eigenvectors of the d x d matrix on the driver (its size is the vector width)
5. ``whiten``         every distinct vector projected once, then joined back to its rows

Only (id, key) and the projections are shuffled for the join; a vector that holds more than
``1 / HOT_SHARE`` of all rows joins by a broadcast (at most ``HOT_SHARE`` such keys exist).

Defined results: rows whose vector is null, empty, holds null or non-finite entries or entries
whose grid value leaves 53 bits (only from about 4e12 on) are left out, and so are vectors of
another length than the commonest (ties: the longer).  A null id stays null, rows that repeat
an id or a vector each get their rows.  A component without variance has ``whitened`` null and
does not count for ``identity_error``, which is null if no component has variance.
``deviation`` is null if it leaves 64 bits; ``deviation_exact`` has all its digits.  An empty
table gives no row.  Other columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import cut_lineage

SCALE, OFFSET, TOP, HOT_SHARE = 1024.0, 100000, 8, 1000
FLAT = 1e-12                                   # an eigenvalue below this share of the largest has no variance


def on_grid(vec: Column, scale: float = SCALE, offset: int = OFFSET) -> Column:
    """``array<long>`` of grid values; null unless every entry has one."""
    scaled = F.transform(vec, lambda c: F.floor(F.when(F.abs(c.cast("double") * scale) < 2.0 ** 52, c.cast("double") * scale)) + offset)
    return F.when((F.size(vec) > 0) & ~F.exists(scaled, lambda x: x.isNull()), scaled)


def grid_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: float = SCALE, offset: int = OFFSET) -> tuple[DataFrame, DataFrame]:
    """``(id, key)`` of every remaining row and ``(key, copies, x)`` of every distinct grid vector."""
    rows = vectors.select(F.col(id_col).alias("id"), on_grid(F.col(vec_col), scale, offset).alias("x")).where("x IS NOT NULL")
    width = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.where(F.size("x") == (width["d"] if width else 0)) \
        .withColumn("key", F.unhex(F.sha2(F.array_join("x", ",").cast("binary"), 256)))
    distinct = cut_lineage(rows.groupBy("key").agg(F.count("*").alias("copies"), F.first("x").alias("x")))
    return rows.select("id", "key"), distinct


def moments(distinct: DataFrame, weight: str) -> tuple[int, list[int]]:
    """Exact n and S of the fit list."""
    at = distinct.select(F.col(weight).alias("w"), F.posexplode("x").alias("i", "v")).groupBy("i").agg(
        F.sum("w").alias("n"), F.sum(F.col("v").cast("decimal(19,0)") * F.col("w").cast("decimal(18,0)")).alias("s"))
    got = at.orderBy("i").collect()
    return (int(got[0]["n"]) if got else 0), [int(r["s"]) for r in got]


def covariance(distinct: DataFrame, weight: str, n: int, sums: list[int]) -> np.ndarray:
    """Covariance with divisor n, centred before multiplying: one partial d x d per task, summed row by row."""
    mean = np.array([s / n for s in sums])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((mean.size, mean.size))
        for pdf in batches:
            if len(pdf):
                y = np.stack(pdf["x"].to_numpy()) - mean
                total += (y * pdf["w"].to_numpy(np.float64)[:, None]).T @ y
        yield pd.DataFrame({"i": np.arange(mean.size), "row": list(total)})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "row": [np.stack(pdf["row"].to_numpy()).sum(0)]})

    parts = distinct.select("x", F.col(weight).alias("w")).mapInPandas(partial, "i int, row array<double>")
    rows = parts.groupBy("i").applyInPandas(add, "i int, row array<double>").collect()
    return np.array([r["row"] for r in sorted(rows, key=lambda r: r["i"])]) / n


def components(cov: np.ndarray, top: int = TOP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``top`` largest eigenvalues, their unit eigenvectors as columns (largest entry positive) and
    their shares of the trace."""
    cov = (cov + cov.T) / 2
    value, vector = np.linalg.eigh(cov)
    value, vector = value[::-1][:top], vector[:, ::-1][:, :top]
    sign = np.sign(vector[np.abs(vector).argmax(0), np.arange(vector.shape[1])])
    trace = np.trace(cov)
    return value, vector * np.where(sign == 0, 1, sign), value / trace if trace > 0 else np.zeros_like(value)


def project(distinct: DataFrame, n: int, sums: list[int], value: np.ndarray, vector: np.ndarray) -> DataFrame:
    """``(key, copies, exact, z)`` of every distinct vector: exact deviation (text) and whitened components."""
    mean = np.array([s / n for s in sums])
    live = value > FLAT * max(float(value[0]), 0.0)
    axes = vector[:, live] / np.sqrt(value[live])
    big = [int(s) for s in sums]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.stack(pdf["x"].to_numpy())
            span = max(abs(n * int(x[:, j].max()) - s) + abs(n * int(x[:, j].min()) - s) for j, s in enumerate(big))
            if span * span * len(big) < 1 << 62 and n * int(np.abs(x).max()) < 1 << 62:
                off = x * n - np.array(big, np.int64)
                exact = [str(v) for v in (off * off).sum(1)]
            else:
                exact = [str(sum((n * int(v) - s) ** 2 for v, s in zip(row, big))) for row in x]
            z = np.full((len(x), value.size), np.nan)
            z[:, live] = (x - mean) @ axes
            yield pd.DataFrame({"key": pdf["key"], "copies": pdf["copies"], "exact": exact, "z": list(z)})

    return distinct.select("key", "copies", "x").mapInPandas(run, "key binary, copies long, exact string, z array<double>")


def identity_error(projected: DataFrame, weight: str, n: int, live: int) -> float | None:
    """Largest absolute entry of the whitened components' covariance minus the identity."""
    if not live:
        return None
    z = [F.col("z")[j] for j in range(live)]
    w = F.col(weight)
    mean = projected.agg(*[F.sum(w * c) / n for c in z]).first()
    y = [c - float(m) for c, m in zip(z, mean)]
    pairs = [(i, j) for i in range(live) for j in range(i, live)]
    cov = projected.agg(*[F.sum(w * y[i] * y[j]) / n for i, j in pairs]).first()
    return max(abs(float(c) - (i == j)) for c, (i, j) in zip(cov, pairs))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", weights: str = "counts", top: int = TOP,
           scale: float = SCALE, offset: int = OFFSET) -> DataFrame:
    """``(id, n, deviation, deviation_exact, whitened array, explained array, identity_error)`` of every
    remaining row; ``weights`` is ``counts`` or ``one``."""
    if weights not in ("counts", "one"):
        raise ValueError("weights must be 'counts' or 'one'")
    weight = "copies" if weights == "counts" else "one"
    rows, distinct = grid_vectors(vectors, id_col, vec_col, scale, offset)
    fit = distinct.withColumn("one", F.lit(1).cast("long"))
    n, sums = moments(fit, weight)
    if not n:
        return rows.select("id", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"),
                           F.lit("").alias("deviation_exact"), F.array().cast("array<double>").alias("whitened"),
                           F.array().cast("array<double>").alias("explained"), F.lit(None).cast("double").alias("identity_error"))
    value, vector, share = components(covariance(fit, weight, n, sums), top)
    flat = cut_lineage(project(fit, n, sums, value, vector), replaces=distinct)
    live = int((value > FLAT * max(float(value[0]), 0.0)).sum())
    error = identity_error(flat.withColumn("one", F.lit(1).cast("long")), weight, n, live)
    z = F.transform("z", lambda c: F.when(~F.isnan(c), c))
    found = flat.select("key", "copies", "exact", z.alias("z"))
    common = F.col("copies") > F.lit(found.agg(F.sum("copies")).first()[0] / HOT_SHARE)
    hot = F.broadcast(found.where(common))
    joined = rows.join(hot, "key").unionByName(
        rows.join(F.broadcast(found.where(common).select("key")), "key", "left_anti").join(found.where(~common), "key"))
    return joined.select(
        "id", F.lit(n).cast("long").alias("n"), F.expr("try_cast(exact AS bigint)").alias("deviation"),
        F.col("exact").alias("deviation_exact"), F.col("z").alias("whitened"),
        F.array(*[F.lit(float(s)) for s in share]).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"))


def long_form(whitened: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """One row per row and component: ``(id, component, n, deviation, whitened, explained, identity_error)``."""
    return whitened.select(F.col("id").alias(id_col), "n", "deviation", "deviation_exact", "identity_error",
                           F.posexplode(F.arrays_zip("whitened", "explained")).alias("i", "c")) \
        .select(id_col, (F.col("i") + 1).cast("int").alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"),
                F.col("c.explained").alias("explained"), "identity_error", "deviation_exact")
