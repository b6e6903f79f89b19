"""ε-neighbourhoods in the plane by cells whose points are all within ε of each other (JOI-6).

Cells have a side just below ε / √2, so all neighbours of a place lie in the 5 x 5 cells around it.  A cell with
enough points needs no distances to know that all of them are cores, and its cores are one cluster.  What is left
to ask is bounded by the number of cells: ``count_near`` counts for places of sparse cells only, ``meet_cells`` compares a few
cores of every cell (one per sub-cell), and ``touching`` looks at the places themselves for pairs of cells that
are still open.  Places go to tasks by hashed blocks of cells with their margin; buckets hold about ``BUCKET`` places,
and places that many others would meet are split further.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDE, REACH, SUB, BLOCK = 0.7071, 2, 3, 16          # side of a cell in ε (1 / √2 = 0.70711), sub-cells a side, cells a block
BUCKET, PAIRS = 1 << 15, 1 << 20


def cell(c: str, eps: Column) -> Column:
    """Cell number of a coordinate, as a double; with ε = 0 every place is its own cell."""
    return F.when(eps == 0, F.col(c)).otherwise(F.rint(F.col(c) / (F.abs(eps) * SIDE)))


def sub_cell(c: str, eps: Column) -> Column:
    return F.when(eps == 0, F.lit(0.0)).otherwise(F.rint(F.col(c) * SUB / (F.abs(eps) * SIDE)))


def _block(cx: Column, cy: Column) -> list[Column]:
    return [F.floor(cx / BLOCK).alias("kx"), F.floor(cy / BLOCK).alias("ky")]


def _own(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("_b", F.pmod(F.xxhash64(*_block(F.col("cx"), F.col("cy"))), F.lit(n)).cast("int"))


def _margin(df: DataFrame, n: int, blocks: DataFrame, by: list[str]) -> DataFrame:
    """Rows in the buckets of all ``blocks`` that have a cell within reach; a bucket may get a row twice."""
    near = [F.struct(*_block(F.col("cx") + dx, F.col("cy") + dy)) for dx in (-REACH, REACH) for dy in (-REACH, REACH)]
    return df.withColumn("_k", F.explode(F.array_distinct(F.array(*near)))).select("*", "_k.*").drop("_k") \
        .join(blocks, [*by, "kx", "ky"], "left_semi").withColumn("_b", F.pmod(F.xxhash64("kx", "ky"), F.lit(n)).cast("int")).drop("kx", "ky")


def _fresh(df: DataFrame) -> DataFrame:
    """The same columns under new attributes, so that a frame may meet itself."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def buckets(rows: int) -> int:
    return max(1, -(-rows // BUCKET))


def _candidates(lx: np.ndarray, ly: np.ndarray, rx: np.ndarray, ry: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) whose cells are within reach; ``rx, ry`` are sorted."""
    ux, uy = np.unique(rx), np.unique(ry)
    key = np.searchsorted(ux, rx) * uy.size + np.searchsorted(uy, ry)
    low, high = np.searchsorted(uy, ly - REACH, "left"), np.searchsorted(uy, ly + REACH, "right") - 1
    for off in range(-REACH, REACH + 1):
        at = np.searchsorted(ux, lx + off)
        ok = np.flatnonzero((at < ux.size) & (ux[np.minimum(at, ux.size - 1)] == lx + off) & (low <= high))
        lo = np.searchsorted(key, at[ok] * uy.size + low[ok], "left")
        count = np.searchsorted(key, at[ok] * uy.size + high[ok], "right") - lo
        end = np.cumsum(count)
        start = 0
        while start < ok.size:
            before = end[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(end, before + PAIRS, "right")))
            n = count[start:stop]
            i = np.repeat(ok[start:stop], n)
            j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[start:stop], n)
            if i.size:
                yield i, j
            start = stop


def _columns(pdf: pd.DataFrame, *names: str) -> list[np.ndarray]:
    return [pdf[c].to_numpy(np.float64) for c in names]


def count_near(asked: DataFrame, places: DataFrame, by: list[str]) -> DataFrame:
    """``(by, x, y, n)``: points within ``eps`` of the places ``asked`` (by, eps, x, y, cx, cy), counted over ``places``
    (by, x, y, w, cx, cy)."""
    n = buckets(places.count())
    blocks = asked.select(*by, *_block(F.col("cx"), F.col("cy"))).distinct()
    left, right = _own(asked, n), _margin(places, n, blocks, by)
    keys = [*by, "_b"]
    parts = right.groupBy(*keys).agg(F.ceil(F.count("*") / (4 * BUCKET)).cast("int").alias("_parts"))
    left = left.join(parts, keys).withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    right = right.join(F.broadcast(parts), keys).withColumn("_t", F.pmod(F.xxhash64("x", "y"), F.col("_parts")).cast("int")).drop("_parts")

    def fn(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        out = lp[[*by, "x", "y"]].reset_index(drop=True)
        total = np.zeros(len(lp), np.int64)
        if len(lp) and len(rp):
            rp = rp.drop_duplicates(["x", "y"]).sort_values(["cx", "cy"])
            x, y, cx, cy = _columns(lp, "x", "y", "cx", "cy")
            rx, ry, kx, ky = _columns(rp, "x", "y", "cx", "cy")
            w, e2 = rp["w"].to_numpy(np.int64), float(lp["eps"].iloc[0]) ** 2
            for i, j in _candidates(cx, cy, kx, ky):
                dx, dy = x[i] - rx[j], y[i] - ry[j]
                near = dx * dx + dy * dy <= e2
                np.add.at(total, i[near], w[j[near]])
        return out.assign(n=total)
    ddl = "".join(f"{b} long, " for b in by)
    got = _fresh(left).groupBy(*keys, "_t").cogroup(_fresh(right).groupBy(*keys, "_t")).applyInPandas(fn, f"{ddl}x double, y double, n long")
    return got.groupBy(*by, "x", "y").agg(F.sum("n").alias("n"))


_BOX = ("x0", "x1", "y0", "y1")
MET = "eps double, ax double, ay double, qx double, qy double, bx double, by double, linked boolean, " + ", ".join(f"{s}{c} double" for s in "ab" for c in _BOX)


def meet_cells(cores: DataFrame, others: DataFrame, by: list[str]) -> DataFrame:
    """Pairs of cells (ax, ay) and (bx, by) with cores within ``eps``, and of places (qx, qy) in ``others`` and such cells:
    ``linked`` by the cores that stand for their cells, or open.  ``cores``: (by, eps, cx, cy, x, y, x0, x1, y0, y1, whole), a few of each
    cell with the box of all, ``whole`` if they are all; ``others``: (by, eps, cx, cy, x, y)."""
    n = buckets(max(cores.count(), others.count()))
    mine = cores.select(*by, "eps", "cx", "cy", "x", "y", *_BOX, "whole", F.lit(True).alias("core")) \
        .unionByName(others.select(*by, "eps", "cx", "cy", "x", "y", F.col("x").alias("x0"), F.col("x").alias("x1"),
                                   F.col("y").alias("y0"), F.col("y").alias("y1"), F.lit(True).alias("whole"), F.lit(False).alias("core")))
    right = cores.select(*by, "cx", "cy", "x", "y", *_BOX, "whole")
    names = [*by, *[c.split()[0] for c in MET.split(", ")]]

    def fn(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        if lp.empty or rp.empty:
            return pd.DataFrame(columns=names)
        e2 = float(lp["eps"].iloc[0]) ** 2
        rp = rp.drop_duplicates(["x", "y"]).sort_values(["cx", "cy"]).reset_index(drop=True)
        rc = (rp[["cx", "cy"]] != rp[["cx", "cy"]].shift()).any(axis=1).cumsum().to_numpy() - 1
        rb = rp[~rp[["cx", "cy"]].duplicated()].reset_index(drop=True)
        lp = lp.sort_values(["core", "cx", "cy"]).reset_index(drop=True)
        core = lp["core"].to_numpy(bool)
        new = (lp[["core", "cx", "cy"]] != lp[["core", "cx", "cy"]].shift()).any(axis=1).to_numpy() | ~core
        lc = new.cumsum() - 1
        lb = lp[new].reset_index(drop=True)
        cells = lb["core"].to_numpy(bool)
        x, y, cx, cy = _columns(lp, "x", "y", "cx", "cy")
        rx, ry, kx, ky = _columns(rp, "x", "y", "cx", "cy")
        hit = [np.zeros(0, np.int64)]
        for i, j in _candidates(cx, cy, kx, ky):
            dx, dy = x[i] - rx[j], y[i] - ry[j]
            near = np.flatnonzero(dx * dx + dy * dy <= e2)
            hit.append(np.unique(lc[i[near]] * len(rb) + rc[j[near]]))
        hit = np.unique(np.concatenate(hit))
        ax, ay, bx, by_ = *_columns(lb, "cx", "cy"), *_columns(rb, "cx", "cy")
        lbox, rbox = _columns(lb, *_BOX), _columns(rb, *_BOX)
        lw, rw = lb["whole"].to_numpy(bool), rb["whole"].to_numpy(bool)
        out = []
        for i, j in _candidates(ax, ay, bx, by_):
            once = ~cells[i] | (ax[i] < bx[j]) | ((ax[i] == bx[j]) & (ay[i] < by_[j]))   # a pair of cells counts once
            i, j = i[once], j[once]
            dx = np.maximum(np.maximum(rbox[0][j] - lbox[1][i], lbox[0][i] - rbox[1][j]), 0.0)
            dy = np.maximum(np.maximum(rbox[2][j] - lbox[3][i], lbox[2][i] - rbox[3][j]), 0.0)
            linked = np.isin(i * len(rb) + j, hit)
            keep = linked | ((dx * dx + dy * dy <= e2) & ~(lw[i] & rw[j]))
            i, j, linked = i[keep], j[keep], linked[keep]
            q = np.where(cells[i], np.nan, 1.0)
            out.append(pd.DataFrame({**{b: lp[b].iloc[0] for b in by}, "eps": lp["eps"].iloc[0], "ax": ax[i], "ay": ay[i], "qx": lbox[0][i] * q, "qy": lbox[2][i] * q,
                                     "bx": bx[j], "by": by_[j], "linked": linked,
                                     **{f"{s}{c}": box[k][t] for s, box, t in (("a", lbox, i), ("b", rbox, j)) for k, c in enumerate(_BOX)}}))
        return pd.concat(out)[names] if out else pd.DataFrame(columns=names)
    keys = [*by, "_b"]
    ddl = "".join(f"{b} long, " for b in by)
    blocks = mine.select(*by, *_block(F.col("cx"), F.col("cy"))).distinct()
    met = _fresh(_own(mine, n)).groupBy(*keys).cogroup(_fresh(_margin(right, n, blocks, by)).groupBy(*keys)).applyInPandas(fn, ddl + MET)
    return met.select(*[F.nanvl(F.col(c), F.lit(None)).alias(c) if c in ("qx", "qy") else c for c in names])


def touching(asked: DataFrame, cores: DataFrame, by: list[str]) -> DataFrame:
    """``_p`` of the pairs in ``asked`` (rows of ``meet_cells`` with a number ``_p``) that have cores, or a place and a
    core, within ``eps``.  ``cores``: all places (by, eps, cx, cy, x, y) of cores."""
    def close(side: str) -> Column:
        dx = F.greatest(F.col(f"{side}x0") - F.col("x"), F.col("x") - F.col(f"{side}x1"), F.lit(0.0))
        dy = F.greatest(F.col(f"{side}y0") - F.col("y"), F.col("y") - F.col(f"{side}y1"), F.lit(0.0))
        return dx * dx + dy * dy <= F.col("eps") * F.col("eps")
    pts = cores.select(*by, "cx", "cy", "x", "y")
    own = asked.where("qx IS NULL").join(pts.withColumnsRenamed({"cx": "ax", "cy": "ay"}), [*by, "ax", "ay"]).where(close("b")).select("_p", "eps", "x", "y") \
        .unionByName(asked.where("qx IS NOT NULL").select("_p", "eps", F.col("qx").alias("x"), F.col("qy").alias("y")))
    other = asked.join(pts.withColumnsRenamed({"cx": "bx", "cy": "by"}), [*by, "bx", "by"]).where(close("a")).select("_p", "x", "y")
    n = buckets(asked.count() * 16)
    parts = other.groupBy("_p").agg(F.ceil(F.count("*") / BUCKET).cast("int").alias("_parts"))
    left = own.join(parts, "_p").withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    right = other.join(parts, "_p").withColumn("_t", F.pmod(F.xxhash64("x", "y"), F.col("_parts")).cast("int"))
    left, right = [s.withColumn("_b", F.pmod(F.xxhash64("_p", "_t"), F.lit(n)).cast("int")).drop("_parts") for s in (left, right)]

    def fn(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        found, rows = [], {k: v for k, v in rp.groupby(["_p", "_t"]).indices.items()}
        rx, ry = _columns(rp, "x", "y")
        x, y, e = _columns(lp, "x", "y", "eps")
        for k, at in lp.groupby(["_p", "_t"]).indices.items():
            j = rows.get(k)
            step = max(1, PAIRS // max(1, 0 if j is None else len(j)))
            for lo in range(0, 0 if j is None else len(at), step):
                i = at[lo:lo + step]
                dx, dy = x[i][:, None] - rx[j][None, :], y[i][:, None] - ry[j][None, :]
                if (dx * dx + dy * dy <= e[i[0]] * e[i[0]]).any():
                    found.append(k[0])
                    break
        return pd.DataFrame({"_p": pd.Series(found, dtype="int64")})
    return _fresh(left).groupBy("_b").cogroup(_fresh(right).groupBy("_b")).applyInPandas(fn, "_p long").distinct()
