"""Embedding near-duplicates by collision-counting projections.

Vectors of one label are compared by cosine.  Each vector is projected on many
random unit directions.  Per pass, the rows are sorted by a compound of ``k`` of
these projections, cut in cells with random offsets; rows of one cell meet.
For every pair that meets, the collisions in query-centred windows are counted
over *all* projections; only pairs with a count that true pairs reach with
probability ``1 - COUNT_MISS`` are verified, by exact cosine in double
precision.  ``calibrate`` picks the number of projections in a compound from the
number of vectors (so that a cell of unrelated vectors stays small), and the
number of passes so that a pair just at the threshold meets in some pass with
probability ``recall``; pairs above it meet more often.

Scale: equal vectors are collapsed first (partial aggregation), so copies are
one weighted row.  A cell of more than ``TILE`` rows is split in hashed tiles
that meet pairwise.  Tasks send one row per vector and group, a link count and
the group-local component, never pairs; a pair is counted only in the first
pass in which it meets.  Components are closed by ``connected_components``.

Defined results: a vector that is null, zero, or holds a null or non-finite
component, or whose label or id is null, links with nothing (a null id has a
null component and is not kept).  Vectors of different lengths never link.
Rows that repeat an id count as vectors of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.graph import connected_components
from quarry.session import cut_lineage

TILE, CELL_TARGET, COUNT_MISS = 1024, 16, 1e-6
CELL_SIGMAS, WINDOW_SIGMAS, BLOCK = 8.0, 2.0, 128


@dataclass(frozen=True)
class Plan:
    """Calibrated parameters; widths are for unit vectors of dimension d, in units of 1 / sqrt(d)."""
    threshold: float
    k: int
    passes: int
    sigma: float        # standard deviation of a projection's difference for a pair at the threshold
    min_count: int
    seed: int = 11

    def directions(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed + 1000 * d)
        r = rng.standard_normal((d, self.k * self.passes))
        return r / np.linalg.norm(r, axis=0), rng.random(self.k * self.passes)


def _same_cell(sigma: float, width: float) -> float:
    """Probability that two points whose difference is N(0, sigma) share a randomly placed cell."""
    x = np.linspace(0, width, 2001)
    density = np.exp(-x * x / (2 * sigma * sigma)) * 2 / (sigma * math.sqrt(2 * math.pi))
    return float(((1 - x / width) * density).sum() * (x[1] - x[0]))


def calibrate(n: int, threshold: float, recall: float) -> Plan:
    sigma = math.sqrt(2 - 2 * threshold)
    width = CELL_SIGMAS * sigma
    p_true, p_rand = _same_cell(sigma, width), _same_cell(math.sqrt(2), width)
    k = min(24, max(2, math.ceil(math.log(max(2.0, n / CELL_TARGET)) / -math.log(p_rand))))
    passes = max(1, math.ceil(math.log(1 - recall) / math.log(1 - p_true ** k)))
    m, p = k * passes, 2 * NormalDist().cdf(WINDOW_SIGMAS) - 1
    below, count, term = 0.0, 0, (1 - p) ** m       # largest count with P(Binomial(m, p) < count) <= COUNT_MISS
    while count < m and below + term <= COUNT_MISS:
        below += term
        term *= (m - count) / (count + 1) * p / (1 - p)
        count += 1
    return Plan(threshold, k, passes, sigma, count)


def _unit(vecs) -> np.ndarray:
    v = np.stack([np.asarray(x, np.float64) for x in vecs])
    return v / np.sqrt((v * v).sum(1))[:, None]


def _with_cells(reps: DataFrame, plan: Plan) -> DataFrame:
    """Adds ``cells array<long>``: one cell per pass."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = np.empty((len(pdf), plan.passes), np.int64)
            for d, rows in pdf.groupby("d").indices.items():
                dirs, offset = plan.directions(int(d))
                width = CELL_SIGMAS * plan.sigma / math.sqrt(d)
                q = np.floor(_unit(pdf["vec"].iloc[rows]) @ dirs / width + offset).astype(np.int64)
                cell = np.zeros((len(rows), plan.passes), np.int64)
                for j in range(plan.k):
                    cell = cell * 1_000_003 + q[:, j::plan.k][:, :plan.passes] + 500_000
                out[rows] = cell
            yield pdf.assign(cells=list(out))

    return reps.mapInPandas(run, "rid long, label int, d int, n long, vec array<float>, cells array<long>")


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def _group_links(plan: Plan, t: int, rid, n, vec, cells, own, split: bool):
    """Link counts and local components of the rows of one cell (or pair of tiles)."""
    order = np.argsort(rid, kind="stable")
    rid, n, cells, own = rid[order], n[order], cells[order], own[order]
    v = _unit([vec[i] for i in order])
    dirs, _ = plan.directions(v.shape[1])
    proj = (v @ dirs).astype(np.float32)
    window = WINDOW_SIGMAS * plan.sigma / math.sqrt(v.shape[1])
    links, union = np.zeros(len(rid), np.int64), _Union(len(rid))
    for a in range(0, len(rid), BLOCK):
        for b in range(a, len(rid), BLOCK):
            pa, pb = proj[a:a + BLOCK], proj[b:b + BLOCK]
            count = (np.abs(pa[:, None, :] - pb[None, :, :]) <= window).sum(2)
            i, j = np.nonzero(count >= plan.min_count)
            i, j = i + a, j + b
            ok = i < j
            if split:
                ok &= own[i] != own[j]
            i, j = i[ok], j[ok]
            first = ~(cells[i, :t] == cells[j, :t]).any(1)      # not met in an earlier pass
            i, j = i[first], j[first]
            near = (v[i] * v[j]).sum(1) >= plan.threshold
            i, j = i[near], j[near]
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            for x, y in zip(i.tolist(), j.tolist()):
                union.join(x, y)
    hit = np.flatnonzero(links)
    return rid[hit], links[hit], rid[[union.find(int(i)) for i in hit]] if hit.size else rid[:0]


KEYS = ["label", "d", "t", "cell", "ta", "tb"]


def _meet(rows: DataFrame, plan: Plan) -> DataFrame:
    """``(rid, links, root)`` per group; groups arrive sorted and are bounded by two tiles."""
    def flush(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pdf[KEYS].to_numpy()
        cut = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        edges = [0, *cut.tolist(), len(pdf)]
        rid, n, own = (pdf[c].to_numpy() for c in ("rid", "n", "own"))
        vec, cells = pdf["vec"].to_numpy(), pdf["cells"].to_numpy()
        out = []
        for a, b in zip(edges, edges[1:]):
            if b - a > 1:
                out.append(_group_links(plan, int(keys[a, 2]), rid[a:b], n[a:b], vec[a:b], np.stack(cells[a:b]), own[a:b],
                                        keys[a, 4] != keys[a, 5]))
        r, k, c = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
        return pd.DataFrame({"rid": r, "links": k, "root": c})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            last = (pdf[KEYS] == pdf[KEYS].iloc[-1]).all(axis=1).to_numpy()
            whole = len(pdf) - int(last.sum())
            if whole:
                yield flush(pdf.iloc[:whole])
            held = pdf.iloc[whole:]
        if held is not None and len(held):
            yield flush(held)

    return rows.mapInPandas(run, "rid long, links long, root long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding",
                    threshold: float = 0.98, recall: float = 0.9999) -> DataFrame:
    """One row per vector: ``(vec_id, n_links, component_id, kept)``."""
    spark = vectors.sparkSession
    v = F.col("vec")
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("int").alias("label"),
                         F.col(vec_col).cast("array<float>").alias("vec"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~F.exists(v, bad)
                        & F.exists(v, lambda x: x != 0), F.lit(False))
    src = src.select("vec_id", "label", F.when(usable, v).alias("vec"),
                     F.xxhash64(F.lit(1), v).alias("k1"), F.xxhash64(F.lit(2), v).alias("k2"))
    reps = src.where("vec IS NOT NULL").groupBy("label", "k1", "k2", "vec").agg(
        F.min("vec_id").alias("rid"), F.count("*").alias("n"))
    reps = cut_lineage(reps.select("rid", "label", F.size("vec").alias("d"), "n", "vec", "k1", "k2"))
    most = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    plan = calibrate(most, threshold, recall)

    placed = cut_lineage(_with_cells(reps.select("rid", "label", "d", "n", "vec"), plan))
    cell = placed.select("rid", "label", "d", F.posexplode("cells").alias("t", "cell"))
    big = cell.groupBy("label", "d", "t", "cell").count().where(F.col("count") > TILE) \
        .select("label", "d", "t", "cell", F.ceil(F.col("count") / TILE).cast("int").alias("tiles"))
    rows = placed.select("*", F.posexplode("cells").alias("t", "cell")).join(big, ["label", "d", "t", "cell"], "left") \
        .withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rid"), F.col("tiles")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("rid", "n", "vec", "cells", "own", "label", "d", "t", "cell",
                       F.least("own", "other").alias("ta"), F.greatest("own", "other").alias("tb"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    found = cut_lineage(_meet(rows.repartition(parts, *KEYS).sortWithinPartitions(*KEYS), plan))

    comp = connected_components(found.where("rid <> root").select("rid", "root"), "rid", "root")
    links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    classes = reps.select("rid", "label", "k1", "k2", "n").join(links, "rid", "left") \
        .join(comp.withColumnRenamed("node", "rid"), "rid", "left") \
        .select("label", "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                F.coalesce("component", "rid").alias("component_id"), F.lit(True).alias("ok"))
    return src.select("vec_id", "label", "k1", "k2", F.col("vec").isNotNull().alias("ok")) \
        .join(classes, ["label", "k1", "k2", "ok"], "left") \
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                F.coalesce("component_id", "vec_id").alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
