"""CLU-2 / PIPE-4: HDBSCAN in the plane as Spark jobs, for many parameter settings at once.

1. **Core distances** of distinct places by tiles (``operators/spatial.py``).
2. **Spanning tree** of mutual reachability ``m = max(core_a, core_b, d)``, by rounds in which components take their
   smallest outgoing edge under the total order (m, d, smaller key, larger key).  The first rounds stay inside a tile:
   a component goes on there while no point beyond the tile can be as near.  Later rounds search inside tiles first;
   what that finds bounds the search in other tiles, and tiles that hold one's own component alone are left out.  Copies of a place hang on its smallest key (their m is their core distance, their d is 0).
3. **Merge tree.**  The rounds are a contraction of the tree, and that gives the dendrogram: an edge goes up through
   the components that hold it until it is lighter than the component's chosen edge.  All edges that stop at one
   component are one chain of the dendrogram, in order; the chain's top hangs on the chosen edge.  Chains nest at
   most as deep as there were rounds.
4. **Sizes** are running sums along chains; a node of at least ``min_cluster_size`` points is big, one with two big
   children is a split, and a cluster is a run of big nodes between splits.
5. **Excess of mass**: a cluster's value is max(stability, sum of its children's values); along a chain that is a
   running maximum, so it takes one pass per round level.  Selection and labels look for the nearest marked
   ancestor by pointer doubling.

One spanning tree answers all settings with its ``min_samples``; ``min_cluster_size``, ``max_cluster_size`` and
``cluster_selection_epsilon`` are keys of the later tables.  Every table is written to the shared folder; groups in
tasks are tiles or parts of chains of bounded size, also where one component or chain holds most rows.

Defined results: label = smallest id among the cluster's points, noise = -1; points without finite coordinates are
noise, and so is everything if there are fewer than ``min_samples`` points or no split.  The root is no cluster.
Equal heights are ordered by the total order above.  Heights below ``FLOOR`` count as ``FLOOR``.  Rows that repeat
an id or a place each get their label.  Ids of any orderable type; text ids give text labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators import spatial
from quarry.operators.relational import skew_join
from quarry.operators.sequence import numbered, running
from quarry.operators.tiles import dealt
from quarry.session import cut_lineage, drop_lineage

FLOOR = 1e-12
CHAIN = ["k", "cj", "cv"]


# -- spanning trees -----------------------------------------------------------------------------------------

def _best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """For every component of ``a`` its smallest edge to a point of another component in ``b``."""
    found = []
    for lo_row in range(0, len(a), 1024):
        p = a.iloc[lo_row:lo_row + 1024]
        d = spatial.distances(p, b)
        m = np.maximum(d, np.maximum(p["core"].to_numpy()[:, None], b["core"].to_numpy()[None, :]))
        m[p["comp"].to_numpy()[:, None] == b["comp"].to_numpy()[None, :]] = np.inf
        low = m.min(1)
        row = np.flatnonzero(np.isfinite(low))
        if not row.size:
            continue
        i, j = np.nonzero(m[row] == low[row][:, None])
        i = row[i]
        pid, qid = p["id"].to_numpy()[i], b["id"].to_numpy()[j]
        found.append(pd.DataFrame({"comp": p["comp"].to_numpy()[i], "m": low[i], "d": d[i, j], "lo": np.minimum(pid, qid),
                                   "hi": np.maximum(pid, qid), "to": b["comp"].to_numpy()[j]}))
    if not found:
        return pd.DataFrame({c: [] for c in ("comp", "m", "d", "lo", "hi", "to")})
    return pd.concat(found).sort_values(["comp", "m", "d", "lo", "hi"]).drop_duplicates("comp")


def _inside(pdf: pd.DataFrame) -> pd.DataFrame:
    """A tile's own edges, and a row about the tile: its component if it has one only, its core distances."""
    out = _best(pdf, pdf)
    comps = pdf["comp"].unique()
    about = pd.DataFrame({"m": [pdf["core"].min()], "d": [pdf["core"].max()], "comp": [comps[0] if len(comps) == 1 else -1], "about": [True]})
    out = pd.concat([out.assign(about=False), about])
    return out.assign(k=pdf["k"].iloc[0], tile=pdf["tile"].iloc[0])[["k", "tile", "about", "comp", "m", "d", "lo", "hi", "to"]]


class _Tiles:
    """Per min_samples and tile: the single component (-1: several) and the smallest and largest core distance."""

    def __init__(self, boxes: spatial.Boxes, rows: list):
        self.boxes = boxes
        place = {int(t): i for i, t in enumerate(boxes.tile)}
        self.comp, self.low, self.high = {}, {}, {}
        for r in rows:
            for table, value, empty in ((self.comp, r["comp"], -2), (self.low, r["m"], np.inf), (self.high, r["d"], np.inf)):
                if r["k"] not in table:
                    table[r["k"]] = np.full(len(place), empty, type(empty) if empty == -2 else np.float64)
                table[r["k"]][place[r["tile"]]] = value

    def bound(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """An upper bound of a component's smallest edge, from one of its tiles and the tiles with others."""
        for pdf in batches:
            out = []
            for k, tile, comp in zip(pdf["k"], pdf["tile"], pdf["comp"]):
                a = int(np.searchsorted(self.boxes.tile, tile))
                other = np.flatnonzero((self.comp[k] != comp) & (self.comp[k] != -2))
                if other.size:
                    reach = np.maximum(self.boxes.farthest(a, other), np.maximum(self.high[k][a], self.high[k][other]))
                    out.append((k, comp, float(reach.min())))
            yield pd.DataFrame(out, columns=["k", "comp", "r"])

    def send(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Points to the other tiles that may hold a smaller edge of their component."""
        for pdf in batches:
            pdf = pdf[pdf["core"] <= pdf["r"]].reset_index(drop=True)
            for k, part in pdf.groupby("k"):
                p, t = self.boxes.within(part["x"].to_numpy(), part["y"].to_numpy(), part["r"].to_numpy(), closed=True)
                keep = (self.boxes.tile[t] != part["tile"].to_numpy()[p]) & (self.comp[k][t] != part["comp"].to_numpy()[p]) \
                    & (self.low[k][t] <= part["r"].to_numpy()[p])
                out = part.iloc[p[keep]].copy()
                out["tile"] = self.boxes.tile[t[keep]]
                yield out[["k", "tile", "id", "x", "y", "core", "comp"]]


def _between(asked: pd.DataFrame, here: pd.DataFrame) -> pd.DataFrame:
    out = _best(asked, here) if len(asked) and len(here) else pd.DataFrame({c: [] for c in ("comp", "m", "d", "lo", "hi", "to")})
    return out.assign(k=asked["k"].iloc[0] if len(asked) else 0)[["k", "comp", "m", "d", "lo", "hi", "to"]]


_LOCAL = "kind string, k int, tile long, level int, comp long, m double, d double, lo long, hi long, next long, id long, x double, y double, core double"


def _settle(boxes: spatial.Boxes):
    """Rounds inside a tile as long as they are safe: a component takes its smallest edge in the tile if no point beyond
    can be as near as that, by the boxes of the other tiles.  Gives the rounds and every point's component."""
    columns = [c.split()[0] for c in _LOCAL.split(", ")]

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        k, tile, ids = int(pdf["k"].iloc[0]), int(pdf["tile"].iloc[0]), pdf["id"].to_numpy(np.int64)
        core, n = pdf["core"].to_numpy(np.float64), len(pdf)
        d = spatial.distances(pdf, pdf)
        m = np.maximum(d, np.maximum(core[:, None], core[None, :]))
        a, b = np.triu_indices(n, 1)
        lo, hi = np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])
        order = np.lexsort((hi, lo, d[a, b], m[a, b]))
        rank = np.full((n, n), order.size, np.int64)
        rank[a[order], b[order]] = rank[b[order], a[order]] = np.arange(order.size)
        at = int(np.searchsorted(boxes.tile, tile))
        wide = float(np.hypot(boxes.x1[at] - boxes.x0[at], boxes.y1[at] - boxes.y0[at]))
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        p, t = boxes.within(x, y, np.full(n, wide), closed=True)
        p, t = p[t != at], t[t != at]
        edge = np.full(n, wide if boxes.tile.size > 1 else np.inf)
        np.minimum.at(edge, p, boxes.distance(x[p], y[p], t))
        safe, comp, rows, level = np.maximum(core, edge), np.arange(n), [], 0
        while True:
            names, where = np.unique(comp, return_inverse=True)
            if names.size == 1:
                break
            best = np.where(comp[:, None] == comp[None, :], order.size, rank).min(1)
            low, bound = np.full(names.size, order.size), np.full(names.size, np.inf)
            np.minimum.at(low, where, best)
            np.minimum.at(bound, where, safe)
            e = order[low]
            go = np.flatnonzero(m[a[e], b[e]] < bound)
            if not go.size:
                break
            level += 1
            ends = np.stack([where[a[e]], where[b[e]]])
            to = np.where(ends[0] == np.arange(names.size), ends[1], ends[0])
            up = np.arange(names.size)
            up[go] = to[go]
            twin = (up[up] == np.arange(names.size)) & (np.arange(names.size) < up)
            up[twin] = np.flatnonzero(twin)
            while (up[up] != up).any():
                up = up[up]
            for c in go:
                rows.append(("round", k, tile, level, ids[names[c]], m[a[e[c]], b[e[c]]], d[a[e[c]], b[e[c]]],
                             min(ids[a[e[c]]], ids[b[e[c]]]), max(ids[a[e[c]]], ids[b[e[c]]]), ids[names[up[c]]], None, None, None, None))
            comp = names[up][where]
        points = [("point", k, tile, None, ids[comp[i]], None, None, None, None, None, ids[i], x[i], y[i], core[i]) for i in range(n)]
        return pd.DataFrame(rows + points, columns=columns, dtype=object)
    return fn


def _chosen(state: DataFrame, boxes: spatial.Boxes, groups: int) -> DataFrame:
    """``(k, comp, e, to)``: the smallest outgoing edge of every component, and the component it leads to."""
    ddl = "comp long, m double, d double, lo long, hi long, to long"
    local = cut_lineage(dealt(state, ["k", "tile"], groups).groupBy("k", "tile").applyInPandas(_inside, f"k int, tile long, about boolean, {ddl}"))
    edges = local.where("NOT about").select("k", "comp", F.struct(F.struct("m", "d", "lo", "hi").alias("e"), "to").alias("b"))
    about = _Tiles(boxes, local.where("about").select("k", "tile", "comp", "m", "d").collect())
    known = edges.groupBy("k", "comp").agg(F.min("b.e.m").alias("r"))
    alone = local.where("about AND comp >= 0").select("k", "tile", "comp").join(known, ["k", "comp"], "left_anti")
    bounds = alone.mapInPandas(about.bound, "k int, comp long, r double").groupBy("k", "comp").agg(F.min("r").alias("r"))
    asked = skew_join(state, known.unionByName(bounds), ["k", "comp"]) \
        .mapInPandas(about.send, "k int, tile long, id long, x double, y double, core double, comp long")
    far = dealt(asked, ["k", "tile"], groups).groupBy("k", "tile").cogroup(dealt(state, ["k", "tile"], groups).groupBy("k", "tile")).applyInPandas(_between, f"k int, {ddl}")
    both = edges.unionByName(far.select("k", "comp", F.struct(F.struct("m", "d", "lo", "hi").alias("e"), "to").alias("b")))
    out = cut_lineage(both.groupBy("k", "comp").agg(F.min("b").alias("b")).select("k", "comp", "b.e", "b.to"))
    drop_lineage(local)
    return out


def _roots(chosen: DataFrame) -> DataFrame:
    """``(k, comp, next)``: components joined by the chosen edges, named by the smaller end of the only edge that two
    components chose together."""
    back = chosen.select("k", F.col("comp").alias("to"), F.col("to").alias("again"))
    par = cut_lineage(chosen.select("k", "comp", "to").join(back, ["k", "to"], "left").select(
        "k", "comp", F.when((F.col("again") == F.col("comp")) & (F.col("comp") < F.col("to")), F.col("comp"))
        .otherwise(F.col("to")).alias("next"), F.lit(True).alias("moved")))
    while par.where("moved").limit(1).count():
        up = par.select("k", F.col("comp").alias("next"), F.col("next").alias("far"))
        again = par.select("k", F.col("comp").alias("far"), F.col("next").alias("farther"))
        par = cut_lineage(par.join(up, ["k", "next"], "left").withColumn("far", F.coalesce("far", "next")).join(again, ["k", "far"], "left").select(
            "k", "comp", F.coalesce("farther", "far").alias("next"), (F.coalesce("farther", "far") != F.col("next")).alias("moved")),
            replaces=par)
    return par.select("k", "comp", "next")


def core_distances(points: DataFrame, values: list[int], *, key: str, x: str, y: str, tile_size: int = spatial.TILE) -> DataFrame:
    """``(key, k, core)``: distance of every point with finite coordinates to its k-th nearest, itself counted."""
    spots, boxes = spatial.tiles(spatial.places(points, key, x, y), tile_size)
    radius = spatial.neighbour_radii(spots, boxes, values).withColumnRenamed("id", "_spot")
    named = points.select(F.col(key), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")) \
        .join(spots.select(F.col("id").alias("_spot"), F.col("x").alias("_x"), F.col("y").alias("_y")), ["_x", "_y"])
    return named.join(radius, "_spot").select(key, "k", F.col("radius").alias("core"))


def spanning_trees(points: DataFrame, values: list[int], *, key: str, x: str, y: str,
                   tile_size: int = spatial.TILE) -> tuple[DataFrame, DataFrame]:
    """Edges ``(k, e, level, v)`` of the spanning tree of every ``min_samples`` k, with the round that chose them and
    the component ``v`` they are in after it, and the rounds ``(k, level, comp, e, next)``.  Keys are longs without
    repetition."""
    spots, boxes = spatial.tiles(spatial.places(points, key, x, y), tile_size)
    radius = spatial.neighbour_radii(spots, boxes, values).where("radius IS NOT NULL")
    spots_k = spots.join(radius.select("id", "k", F.col("radius").alias("core")), "id")
    state = cut_lineage(spots_k.select(F.col("k").cast("int").alias("k"), "tile", "id", "x", "y", "core", F.col("id").alias("comp")))
    # copies of a place: all but the smallest key hang on it
    at = points.select(F.col(key).alias("hi"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) \
        .join(spots.where("copies > 1").select("x", "y", F.col("id").alias("lo")), ["x", "y"]).where("hi <> lo")
    copies = cut_lineage(at.join(state.select("k", F.col("id").alias("lo"), "core"), "lo").select(
        "k", F.struct(F.col("core").alias("m"), F.lit(0.0).alias("d"), "lo", "hi").alias("e"), F.lit(0).alias("level"), F.col("lo").alias("v")))
    drop_lineage(radius)
    groups = boxes.tile.size * len(values)
    settled = cut_lineage(dealt(state, ["k", "tile"], groups).groupBy("k", "tile").applyInPandas(_settle(boxes), _LOCAL))
    drop_lineage(state)
    edge = F.struct("m", "d", "lo", "hi").alias("e")
    rounds = [settled.where("kind = 'round'").select("k", "level", "comp", edge, "next")]
    level = rounds[0].agg(F.max("level")).first()[0] or 0
    state = settled.where("kind = 'point'").select("k", "tile", "id", "x", "y", "core", "comp")
    while state.select("k", "comp").distinct().count() > state.select("k").distinct().count():
        chosen = _chosen(state, boxes, groups)
        if not chosen.limit(1).count():
            break
        level += 1
        roots = _roots(chosen)
        rounds.append(cut_lineage(chosen.drop("to").join(roots, ["k", "comp"]).select("k", F.lit(level).alias("level"), "comp", "e", "next")))
        drop_lineage(chosen)
        # one row per component and value; a component may hold most points
        state = cut_lineage(skew_join(state, rounds[-1].select("k", "comp", "next"), ["k", "comp"])
                            .select("k", "tile", "id", "x", "y", "core", F.col("next").alias("comp")), replaces=state)
    every = rounds[0]
    for r in rounds[1:]:
        every = every.unionByName(r)
    edges = copies.unionByName(every.groupBy("k", "e").agg(F.max("level").alias("level"), F.max("next").alias("v")))
    return edges, every


# -- merge tree -----------------------------------------------------------------------------------------------

def merge_tree(edges: DataFrame, rounds: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes ``(k, cj, cv, e)`` with their chains, chains ``(k, cj, cv, e, pj, pv)`` with the node their top hangs on
    and its chain (the root's are null), and points ``(k, id, e)`` with the node they hang on."""
    last = rounds.agg(F.max("level")).first()[0] or 0
    todo = cut_lineage(edges)
    count = todo.count()
    done = []
    for level in range(1, last + 1):
        up = rounds.where(F.col("level") == level).select("k", F.col("comp").alias("v"), F.col("e").alias("above"), F.col("next"))
        now = skew_join(todo.where(F.col("level") < level), up, ["k", "v"], how="left", at_most=count)
        step = cut_lineage(now.select("k", "e", "level", "v", "next", (F.col("e") < F.col("above")).alias("here"))
                           .unionByName(todo.where(F.col("level") >= level).select(
                               "k", "e", "level", "v", F.lit(None).cast("long").alias("next"), F.lit(None).cast("boolean").alias("here"))))
        done.append(step.where("here").select("k", F.lit(level).alias("cj"), F.col("v").alias("cv"), "e"))
        drop_lineage(todo)
        todo = step.where("here IS NULL OR NOT here").select("k", "e", "level", F.coalesce("next", "v").alias("v"))
    nodes = todo.select("k", F.lit(last + 1).alias("cj"), F.col("v").alias("cv"), "e")
    for d in done:
        nodes = nodes.unionByName(d)
    nodes = cut_lineage(nodes)
    where = nodes.select("k", "e", F.col("cj").alias("pj"), F.col("cv").alias("pv"))
    tops = rounds.select("k", F.col("level").alias("cj"), F.col("comp").alias("cv"), "e")
    used = nodes.select(*CHAIN).distinct()
    chains = cut_lineage(used.join(tops, CHAIN, "left").join(where, ["k", "e"], "left").select(*CHAIN, "e", "pj", "pv"))
    ends = F.explode(F.array("e.lo", "e.hi")).alias("id")
    points = cut_lineage(edges.select("k", "e", ends).groupBy("k", "id").agg(F.min("e").alias("e")))
    return nodes, chains, points


def sized_nodes(nodes: DataFrame, chains: DataFrame, points: DataFrame) -> DataFrame:
    """Nodes with ``size`` (points below), ``hung`` (points that hang on the node beside the chain) and ``units``
    (at most two: sizes and names of the chains that hang on it)."""
    direct = points.groupBy("k", "e").agg(F.count("*").alias("w"))
    pushed = cut_lineage(nodes.join(direct, ["k", "e"]).groupBy(*CHAIN).agg(F.sum("w").alias("w")))
    parts, steps = [], []
    while pushed.limit(1).count():
        parts.append(pushed)
        up = pushed.join(chains.where("pj IS NOT NULL"), CHAIN).groupBy("k", F.col("pj").alias("cj"), F.col("pv").alias("cv")) \
            .agg(F.sum("w").alias("w"))
        pushed = cut_lineage(up)
    steps = parts[0] if parts else pushed
    for p in parts[1:]:
        steps = steps.unionByName(p)
    total = steps.groupBy(*CHAIN).agg(F.sum("w").alias("w"))
    units = chains.where("pj IS NOT NULL").join(total, CHAIN).groupBy("k", "e").agg(
        F.sum("w").alias("c"), F.sort_array(F.collect_list(F.struct(F.col("w").alias("size"), "cj", "cv")), asc=False).alias("units"))
    hung = nodes.join(direct, ["k", "e"], "left").join(units, ["k", "e"], "left").select(
        *CHAIN, "e", (F.coalesce("w", F.lit(0)) + F.coalesce("c", F.lit(0))).alias("hung"),
        F.coalesce("units", F.array().cast("array<struct<size: bigint, cj: int, cv: bigint>>")).alias("units"))
    out = cut_lineage(running(hung, CHAIN, ["e"], size=("sum", "hung")))
    for p in parts:
        drop_lineage(p)
    return out


# -- condensed clusters ---------------------------------------------------------------------------------------

def condensed(sized: DataFrame, chains: DataFrame, min_sizes: list[int]) -> tuple[DataFrame, DataFrame]:
    """Big nodes ``(k, mcs, cj, cv, e, cluster)`` and clusters ``(k, mcs, cluster, cj, cv, seg, parent, birth, size,
    stability)`` for every ``min_cluster_size``; ``cluster`` is a struct (cj, cv, seg) of the topmost run, ``birth`` the
    height of the split above (null: the root)."""
    key = ["k", "mcs", "cj", "cv"]
    rows = sized.select("*", F.explode(F.array(*[F.lit(int(v)) for v in min_sizes])).alias("mcs")).where("size >= mcs")
    within = F.col("size") - F.col("hung")
    heavy = F.filter("units", lambda u: u["size"] >= F.col("mcs"))
    rows = rows.withColumn("heavy", heavy).withColumn("below", within) \
        .withColumn("kids", F.size("heavy") + (F.col("below") >= F.col("mcs")).cast("int")) \
        .withColumn("split", (F.col("kids") == 2).cast("int"))
    lam = 1.0 / F.greatest(F.col("e.m"), F.lit(FLOOR))
    child = F.when(F.col("below") >= F.col("mcs"), F.col("below")).otherwise(F.col("heavy")[0]["size"])
    out = F.when(F.col("kids") == 1, F.col("size") - child).otherwise(F.col("size"))
    rows = rows.withColumn("out", out)
    big = cut_lineage(running(rows, key, ["e"], seg=("sum", "split")).select(
        *key, "e", "size", "seg", "out", "split", "kids", "below", "heavy"))
    runs = big.groupBy(*key, "seg").agg(F.max("size").alias("size"))
    # the run at the bottom of a chain goes on in the top run of the chain that hangs there, if that child is the only big one
    tops = big.groupBy(*key).agg(F.max("seg").alias("last"))
    goes_on = big.where((F.col("kids") == 1) & (F.col("below") < F.col("mcs"))).select(
        "k", "mcs", F.struct("cj", "cv", "seg").alias("up"), F.col("heavy")[0]["cj"].alias("cj"), F.col("heavy")[0]["cv"].alias("cv"))
    link = runs.join(tops, key).join(goes_on, key, "left").select(
        "k", "mcs", F.struct("cj", "cv", "seg").alias("run"),
        F.when(F.col("seg") == F.col("last"), F.coalesce("up", F.struct("cj", "cv", "seg")))
        .otherwise(F.struct("cj", "cv", "seg")).alias("cluster"))
    link = cut_lineage(link)
    while True:
        up = link.select("k", "mcs", F.col("run").alias("cluster"), F.col("cluster").alias("far"))
        nxt = cut_lineage(link.join(up, ["k", "mcs", "cluster"]).select(
            "k", "mcs", "run", F.col("far").alias("cluster"), (F.col("far") != F.col("cluster")).alias("moved")), replaces=link)
        link = nxt
        if not nxt.where("moved").limit(1).count():
            break
    link = link.drop("moved")
    big_in = cut_lineage(big.withColumn("run", F.struct("cj", "cv", "seg")).join(link, ["k", "mcs", "run"]).drop("run"))
    named = runs.withColumn("run", F.struct("cj", "cv", "seg")).join(link, ["k", "mcs", "run"])
    # born below a split: the next run of the same chain starts with it, or it hangs on a split of another chain
    next_run = big_in.where("split = 1").select(*key, (F.col("seg") - 1).alias("seg"), F.col("cluster").alias("p1"), F.col("e.m").alias("b1"))
    hangs = big_in.where("split = 1").select("k", "mcs", F.explode("heavy").alias("u"), F.col("cluster").alias("p2"), F.col("e.m").alias("b2")) \
        .select("k", "mcs", F.col("u.cj").alias("cj"), F.col("u.cv").alias("cv"), "p2", "b2")
    own = named.where(F.col("run") == F.col("cluster")).join(tops, key).join(next_run, [*key, "seg"], "left").join(hangs, key, "left") \
        .select(*key, "seg", "cluster", "size",
                F.when(F.col("seg") < F.col("last"), F.col("p1")).otherwise(F.col("p2")).alias("parent"),
                F.when(F.col("seg") < F.col("last"), F.col("b1")).otherwise(F.col("b2")).alias("birth"))
    own = cut_lineage(own)
    since = F.coalesce(1.0 / F.greatest("birth", F.lit(FLOOR)), F.lit(0.0))
    total = skew_join(big_in.select("k", "mcs", "cluster", "out", lam.alias("lam")), own.select("k", "mcs", "cluster", "birth"),
                      ["k", "mcs", "cluster"]) \
        .groupBy("k", "mcs", "cluster").agg(F.sum(F.col("out") * (F.col("lam") - since)).alias("stability"))
    clusters = cut_lineage(own.join(total, ["k", "mcs", "cluster"]).select(
        *key, "seg", "cluster", "parent", "birth", "size", "stability"), replaces=own)
    drop_lineage(big)
    return big_in, clusters


def nearest_marked(tree: DataFrame, keys: list[str], node: str, parent: str, mark: str) -> DataFrame:
    """``(keys, node, near)``: the nearest ancestor with ``mark``, the node itself included (null: none)."""
    at = cut_lineage(tree.select(*keys, node, F.when(F.col(mark), F.col(node)).otherwise(F.col(parent)).alias("near")))
    while True:                                               # two hops a pass
        up = at.select(*keys, F.col(node).alias("near"), F.col("near").alias("far"))
        again = at.select(*keys, F.col(node).alias("far"), F.col("near").alias("farther"))
        step = at.join(up, [*keys, "near"], "left").join(again, [*keys, "far"], "left").select(
            *keys, node, F.col("farther").alias("near"), (F.col("near").isNotNull() & ~F.col("farther").eqNullSafe(F.col("near"))).alias("moved"))
        at = cut_lineage(step, replaces=at)
        if not at.where("moved").limit(1).count():
            return at.drop("moved")


def winners(clusters: DataFrame, max_sizes: list[int | None]) -> DataFrame:
    """``(k, mcs, mx, cluster, parent, birth, win)``: excess of mass, one pass per chain level."""
    sizes = F.explode(F.array(*[F.lit(v).cast("long") for v in max_sizes]))
    every = clusters.withColumn("mx", sizes).withColumn("allowed", F.col("parent").isNotNull() & (F.col("mx").isNull() | (F.col("size") <= F.col("mx")))) \
        .withColumn("mx", F.coalesce("mx", F.lit(-1).cast("long")))
    every = cut_lineage(every)
    key = ["k", "mcs", "mx"]
    chain = [*key, "cj", "cv"]
    done = None
    levels = [r["cj"] for r in every.select("cj").distinct().orderBy("cj").collect()]
    for j in levels:
        here = every.where(F.col("cj") == j)
        if done is None:
            got = here.withColumn("xh", F.lit(0.0))
        else:
            sums = done.groupBy(*key, F.col("parent").alias("cluster")).agg(F.sum("value").alias("xh"))
            got = here.join(sums, [*key, "cluster"], "left").withColumn("xh", F.coalesce("xh", F.lit(0.0)))
        gain = F.when(F.col("allowed"), F.col("stability") - F.col("base")).otherwise(F.lit(0.0))
        run = cut_lineage(running(got, chain, ["seg"], base=("sum", "xh"), best=("max", gain))
                          .withColumn("value", F.col("base") + F.greatest("best", F.lit(0.0))))
        before = run.select(*chain, (F.col("seg") + 1).alias("seg"), F.col("value").alias("prior"))
        level = cut_lineage(run.join(before, [*chain, "seg"], "left").select(
            *key, "cluster", "parent", "birth", "value",
            (F.col("allowed") & (F.col("xh") + F.coalesce("prior", F.lit(0.0)) <= F.col("stability"))).alias("win")), replaces=run)
        done = level if done is None else done.unionByName(level)
    if done is None:
        return every.select(*key, "cluster", "parent", "birth", F.lit(False).alias("win"))
    return done.drop("value")


def selected(clusters: DataFrame, max_sizes: list[int | None], epsilons: list[float]) -> DataFrame:
    """``(k, mcs, mx, eps, cluster, near)``: the selected cluster that holds each cluster (null: none)."""
    won = winners(clusters, max_sizes)
    key = ["k", "mcs", "mx"]
    above = nearest_marked(won, key, "cluster", "parent", "win")
    top = won.join(above.select(*key, F.col("cluster").alias("parent"), F.col("near").alias("over")), [*key, "parent"], "left") \
        .where("win AND over IS NULL").select(*key, "cluster", "birth")
    eps = F.explode(F.array(*[F.lit(float(v)) for v in epsilons])).alias("eps")
    tree = clusters.select("k", "mcs", "cluster", "parent", "birth")
    root = tree.where("parent IS NULL").select("k", "mcs", F.col("cluster").alias("parent"), F.lit(True).alias("under_root"))
    wide = tree.join(root, ["k", "mcs", "parent"], "left").select("k", "mcs", "cluster", "parent", "birth", "under_root", eps) \
        .withColumn("wide", F.coalesce((F.col("birth") > F.col("eps")) | F.col("under_root"), F.lit(False)))
    target = nearest_marked(wide, ["k", "mcs", "eps"], "cluster", "parent", "wide").withColumnRenamed("near", "target")
    final = top.select("*", eps).join(target, ["k", "mcs", "eps", "cluster"]).select(
        *key, "eps", F.when((F.col("eps") == 0) | (F.col("birth") >= F.col("eps")), F.col("cluster")).otherwise(F.col("target")).alias("cluster"),
        F.lit(True).alias("mark")).distinct()
    settings = won.select(*key, "cluster", "parent", eps).join(final, [*key, "eps", "cluster"], "left") \
        .withColumn("mark", F.coalesce("mark", F.lit(False)))
    out = nearest_marked(settings, [*key, "eps"], "cluster", "parent", "mark")
    drop_lineage(won)
    return out


def entries(big: DataFrame, nodes: DataFrame, chains: DataFrame, points: DataFrame, min_sizes: list[int]) -> DataFrame:
    """``(k, mcs, id, cluster)``: the cluster each point falls out of (no row: the root has fewer points)."""
    named = nodes.select("k", "e", "cj", "cv")
    sizes = F.explode(F.array(*[F.lit(int(v)) for v in min_sizes])).alias("mcs")
    lowest = big.groupBy("k", "mcs", "cj", "cv").agg(F.min(F.struct("e", "cluster")).alias("low"))
    # a chain without a big node hands its points to the node its top hangs on
    handed = chains.select("k", "cj", "cv", "e", "pj", "pv", sizes)
    at = cut_lineage(handed.select("k", "mcs", "cj", "cv", "e", F.col("pj").alias("tj"), F.col("pv").alias("tv")))
    small = cut_lineage(handed.join(lowest.select("k", "mcs", "cj", "cv"), ["k", "mcs", "cj", "cv"], "left_anti")
                        .select("k", "mcs", F.col("cj").alias("tj"), F.col("cv").alias("tv"), F.col("e").alias("e2"), F.col("pj").alias("pj2"), F.col("pv").alias("pv2")))
    while True:
        hop = at.join(small, ["k", "mcs", "tj", "tv"], "left")
        moved = F.col("e2").isNotNull()
        nxt = cut_lineage(hop.select("k", "mcs", "cj", "cv", F.coalesce("e2", "e").alias("e"), F.when(moved, F.col("pj2")).otherwise(F.col("tj")).alias("tj"),
                                     F.when(moved, F.col("pv2")).otherwise(F.col("tv")).alias("tv"), moved.alias("moved")), replaces=at)
        at = nxt.drop("moved")
        at._quarry_path = nxt._quarry_path
        if not nxt.where("moved").limit(1).count():
            break
    start = skew_join(points, named, ["k", "e"]).select("*", sizes)
    is_small = small.select("k", "mcs", F.col("tj").alias("cj"), F.col("tv").alias("cv"), F.lit(True).alias("small"))
    via = at.select("k", "mcs", "cj", "cv", F.col("e").alias("e3"), F.col("tj").alias("j3"), F.col("tv").alias("v3")) \
        .join(is_small, ["k", "mcs", "cj", "cv"])
    placed = skew_join(start, via, ["k", "mcs", "cj", "cv"], how="left").select(
        "k", "mcs", "id", *[F.when(F.col("small"), F.col(a)).otherwise(F.col(b)).alias(b) for a, b in (("e3", "e"), ("j3", "cj"), ("v3", "cv"))])
    exact = big.select("k", "mcs", "e", F.col("cluster").alias("own"))
    here = skew_join(skew_join(placed.where("cv IS NOT NULL"), exact, ["k", "mcs", "e"], how="left"),
                     lowest, ["k", "mcs", "cj", "cv"], how="left")
    return here.select("k", "mcs", "id", F.coalesce("own", "low.cluster").alias("cluster")).where("cluster IS NOT NULL")


# -- the operator ---------------------------------------------------------------------------------------------

def cluster_grid(points: DataFrame, configs: list[dict], *, id_col: str, x: str, y: str, tile_size: int = spatial.TILE) -> DataFrame:
    """``(config_id, id, x, y, cluster)`` of every point and every setting: dicts with ``config_id``, ``min_cluster_size``,
    ``min_samples`` (default: min_cluster_size), ``max_cluster_size`` (None: any), ``cluster_selection_epsilon`` (0)."""
    spark = points.sparkSession
    full = [{"config_id": int(c["config_id"]), "k": int(c.get("min_samples") or c["min_cluster_size"]), "mcs": int(c["min_cluster_size"]),
             "mx": int(c.get("max_cluster_size") or -1), "eps": float(c.get("cluster_selection_epsilon") or 0.0)} for c in configs]
    if any(c["mcs"] < 2 or c["k"] < 1 for c in full):
        raise ValueError("min_cluster_size must be at least 2 and min_samples at least 1")
    values, min_sizes = sorted({c["k"] for c in full}), sorted({c["mcs"] for c in full})
    max_sizes = sorted({c["mx"] for c in full})
    rows = numbered(points.select(id_col, x, y), [id_col, x, y], "_key")
    edges, rounds = spanning_trees(rows, values, key="_key", x=x, y=y, tile_size=tile_size)
    nodes, chains, hanging = merge_tree(edges, rounds)
    sized = sized_nodes(nodes, chains, hanging)
    big, clusters = condensed(sized, chains, min_sizes)
    near = selected(clusters, [None if v < 0 else v for v in max_sizes], sorted({c["eps"] for c in full}))
    wanted = F.broadcast(spark.createDataFrame([tuple(c.values()) for c in full], "config_id long, k int, mcs int, mx long, eps double"))
    fell = cut_lineage(entries(big, nodes, chains, hanging, min_sizes))
    picked = near.join(wanted, ["k", "mcs", "mx", "eps"]).where("near IS NOT NULL").select("config_id", "k", "mcs", "cluster", "near")
    named = skew_join(fell, picked.groupBy("k", "mcs", "cluster").agg(F.collect_list(F.struct("config_id", "near")).alias("in")), ["k", "mcs", "cluster"]) \
        .select(F.col("id").alias("_key"), F.explode("in").alias("c")).select("_key", "c.config_id", "c.near")
    named = cut_lineage(named.join(rows.select("_key", id_col), "_key"))
    smallest = named.groupBy("config_id", "near").agg(F.min(id_col).alias("label"))
    labels = skew_join(named.drop(id_col), smallest, ["config_id", "near"]).select("config_id", "_key", "label")
    grid = F.explode(F.array(*[F.lit(c["config_id"]).cast("long") for c in full])).alias("config_id")
    kind = points.schema[id_col].dataType
    noise = F.lit(-1).cast(kind) if isinstance(kind, T.NumericType) else F.lit("-1")
    label = F.col("label") if isinstance(kind, T.NumericType) else F.col("label").cast("string")
    return rows.select("_key", id_col, x, y, grid).join(labels, ["config_id", "_key"], "left") \
        .select("config_id", id_col, x, y, F.coalesce(label, noise).alias("cluster"))


def hdbscan(points: DataFrame, *, id_col: str, x: str, y: str, min_cluster_size: int = 5, min_samples: int | None = None,
            max_cluster_size: int | None = None, cluster_selection_epsilon: float = 0.0, tile_size: int = spatial.TILE) -> DataFrame:
    """``(id, x, y, cluster)`` of every point for one setting."""
    one = {"config_id": 0, "min_cluster_size": min_cluster_size, "min_samples": min_samples, "max_cluster_size": max_cluster_size,
           "cluster_selection_epsilon": cluster_selection_epsilon}
    return cluster_grid(points, [one], id_col=id_col, x=x, y=y, tile_size=tile_size).drop("config_id")


def spanning_tree(points: DataFrame, *, id_col: str, x: str, y: str, min_samples: int, tile_size: int = spatial.TILE) -> DataFrame:
    """Edges ``(lo, hi, weight)`` of the mutual-reachability spanning tree for one ``min_samples`` (integer ids
    without repetition)."""
    edges, _ = spanning_trees(points, [min_samples], key=id_col, x=x, y=y, tile_size=tile_size)
    return edges.select(F.col("e.lo").alias("lo"), F.col("e.hi").alias("hi"), F.col("e.m").alias("weight"))
