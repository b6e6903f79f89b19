"""Order-dependent group operators without one-task groups (WIN-7 / SUM-3 at scale).

``group_prefix``: ordinal and inclusive prefix sum per group.  Rows are range
partitioned on (group, order), so a group holding a third of all rows spans
many partitions; each partition counts locally in Arrow batches, and
per-(group, partition) totals — at most one row per partition a group spans —
give the offsets.

``greedy_windows``: the greedy packing rule (a document opens a new window iff
the window is non-empty and ``overhead + used + sep + t > limit``) computed
exactly without holding a group in one task:

1. ordinals ``i`` and prefix sums ``R_i = Σ_{j≤i} (t_j + sep)`` (group_prefix);
2. documents without cost (``t + sep = 0``) are represented by the first of their
   run, so that two neighbours cost at least ``c_min`` (the smallest positive
   cost) and a window spans fewer than ``B = 2 (⌊(limit - overhead) / c_min⌋ + 1) + 1``
   of them; so the successor start
   ``next(s) = max(s+1, first u with R_u > limit - overhead + R_s - t_s)`` lies
   in the block of ``s`` or the next one: one bounded (block, next block)
   group per task, numpy ``searchsorted``;
3. ``exit(s)`` = first start at or beyond the next block on the path from
   ``s`` (local to the block); block entries ``e_0 = 0, e_{b+1} = exit(e_b)``
   come from pointer doubling — ⌈log2 #blocks⌉ rounds of joins;
4. starts inside each block follow ``next`` from its entry; window numbers =
   per-block start counts prefix-summed (group_prefix again) + local rank.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import cut_lineage


def _gkey(group: list[str]):
    """One string per distinct key tuple; a null differs from every value."""
    return F.concat_ws("\u0001", *[F.coalesce(F.concat(F.lit("v"), F.col(g).cast("string")), F.lit("n")) for g in group]) \
        if group else F.lit("")


def group_prefix(df: DataFrame, group: list[str], order: list[str], value: str,
                 num_partitions: int | None = None) -> DataFrame:
    """Adds ``_i`` (0-based ordinal by ``order``) and ``_cum`` (inclusive prefix
    sum of the non-negative ``value``) within each group."""
    spark = df.sparkSession
    p = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = df.withColumn("_pk", _gkey(group))
    r = d.repartitionByRange(p, "_pk", *order).sortWithinPartitions("_pk", *order)
    schema = T.StructType([*d.schema.fields, T.StructField("_pid", T.IntegerType()),
                           T.StructField("_li", T.LongType()), T.StructField("_lc", T.LongType())])

    def local(batches):
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        last, cnt, cum = None, 0, 0
        for pdf in batches:
            if pdf.empty:
                continue
            k = pdf["_pk"].to_numpy()
            v = pdf[value].to_numpy(np.int64)
            run = np.concatenate([[True], k[1:] != k[:-1]]).cumsum()
            li = pdf.groupby(run).cumcount().to_numpy(np.int64)
            lc = pd.Series(v).groupby(run).cumsum().to_numpy(np.int64)
            first = run == 1
            if last is not None and k[0] == last:
                li[first] += cnt
                lc[first] += cum
            last, cnt, cum = k[-1], int(li[-1]) + 1, int(lc[-1])
            yield pdf.assign(_pid=pid, _li=li, _lc=lc)
    loc = cut_lineage(r.mapInPandas(local, schema))
    tot = loc.groupBy("_pk", "_pid").agg((F.max("_li") + 1).alias("_n"), F.max("_lc").alias("_s"))
    w = Window.partitionBy("_pk").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select("_pk", "_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_on"),
                     F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_os"))
    out = loc.join(off, ["_pk", "_pid"])
    return out.select(*df.columns, (F.col("_li") + F.col("_on")).alias("_i"),
                      (F.col("_lc") + F.col("_os")).alias("_cum"))


def _next_fn(limit: int, overhead: int, B: int):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i", kind="mergesort")
        b = int(pdf["_bk"].iloc[0])
        m = int(pdf["_m"].iloc[0])
        i = pdf["_i"].to_numpy(np.int64)
        R = pdf["_cum"].to_numpy(np.int64)
        t = pdf["_t"].to_numpy(np.int64)
        own = (i // B) == b
        thr = limit - overhead + R[own] - t[own]
        pos = np.searchsorted(R, thr, side="right")
        found = pos < len(R)
        nxt = np.where(found, i[np.minimum(pos, len(R) - 1)], m)
        if (~found).any() and i.max() < m - 1:
            raise RuntimeError("greedy_windows: block bound violated")
        s = i[own]
        nxt = np.maximum(nxt, s + 1)
        nxt = np.minimum(nxt, m)
        # exit(s): first start >= next block boundary on the path from s
        end = (b + 1) * B
        ex = np.empty_like(nxt)
        where = {int(v): k for k, v in enumerate(s)}
        for k in range(len(s) - 1, -1, -1):
            n = int(nxt[k])
            ex[k] = n if n >= end or n >= m else ex[where[n]]
        return pd.DataFrame({"_gk": pdf["_gk"].iloc[0], "_i": s, "_next": nxt, "_exit": ex, "_m": m})
    return fn


def _starts_fn(B: int):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i", kind="mergesort")
        i = pdf["_i"].to_numpy(np.int64)
        nxt = pdf["_next"].to_numpy(np.int64)
        e = int(pdf["_e"].iloc[0])
        pos = {int(v): k for k, v in enumerate(i)}
        start = np.zeros(len(i), dtype=bool)
        cur = e
        while cur in pos:
            start[pos[cur]] = True
            cur = int(nxt[pos[cur]])
        return pd.DataFrame({"_gk": pdf["_gk"].iloc[0], "_bk": pdf["_bk"].iloc[0], "_i": i,
                             "_lw": np.cumsum(start).astype(np.int64)})
    return fn


def greedy_windows(df: DataFrame, group: list[str], order: str, tokens_col: str, limit: int,
                   overhead: int = 0, sep_tokens: int = 0) -> DataFrame:
    """Adds ``window`` (0-based within the group); exact greedy packing rule.

    Every row gets one window: rows are keyed by a row number stored with them,
    so null groups and equal order values neither lose nor multiply rows (equal
    order values are packed in the order of that number)."""
    df = cut_lineage(df.withColumn("_rid", F.monotonically_increasing_id()))
    base = df.select(_gkey(group).alias("_gk"), F.col(order).alias("_ord"), "_rid",
                     F.coalesce(F.col(tokens_col), F.lit(0)).cast("long").alias("_t"))
    base = base.withColumn("_c", F.col("_t") + F.lit(sep_tokens))
    if overhead > limit:            # nothing fits beside anything: every document stands alone
        alone = group_prefix(base, ["_gk"], ["_ord", "_rid"], "_c").select("_rid", F.col("_i").alias("window"))
        return df.join(alone, "_rid").drop("_rid")
    c_min = base.where("_c > 0").agg(F.min("_c")).first()[0] or 1
    # documents without cost share the prefix sum of the one before them and its window, or the window that the
    # first of them opens: only that first one is packed, so two neighbours cost at least c_min
    docs = cut_lineage(group_prefix(base, ["_gk"], ["_ord", "_rid"], "_c").drop("_i"))
    free = docs.where("_c = 0")
    rep = free.groupBy("_gk", F.col("_cum").alias("_run")).agg(F.min(F.struct("_ord", "_rid")).alias("f"))
    units = docs.where("_c > 0").select("_gk", "_ord", "_rid", "_t", "_c").unionByName(
        rep.select("_gk", "f._ord", "f._rid", F.lit(0).cast("long").alias("_t"), F.lit(0).cast("long").alias("_c")))
    win = cut_lineage(_unit_windows(units, limit, overhead, int(c_min)))
    first = rep.select("_gk", "_run", F.col("f._rid").alias("_first")).join(
        win.select(F.col("_rid").alias("_first"), "window"), "_first")
    of_free = free.select("_gk", "_rid", F.col("_cum").alias("_run")).join(first, ["_gk", "_run"]).select("_rid", "window")
    of_unit = docs.where("_c > 0").select("_rid").join(win, "_rid").select("_rid", "window")
    return df.join(of_unit.unionByName(of_free), "_rid").drop("_rid")


def _unit_windows(units: DataFrame, limit: int, overhead: int, c_min: int) -> DataFrame:
    """``(_rid, window)`` of units of which two neighbours cost at least ``c_min``."""
    B = 2 * (max(0, limit - overhead) // c_min + 1) + 1
    pre = group_prefix(units, ["_gk"], ["_ord", "_rid"], "_c")
    pre = pre.select("_gk", "_rid", "_i", "_cum", "_t")
    sizes = pre.groupBy("_gk").agg(F.count("*").alias("_m"))
    pre = cut_lineage(pre.join(sizes, "_gk").withColumn("_b", F.floor(F.col("_i") / B).cast("long")))
    sizes = cut_lineage(pre.groupBy("_gk").agg(F.count("*").alias("_m")))
    # step 2-3: every row of block b+1 also joins group (gk, b) as look-ahead
    la = pre.select("*", F.explode(F.array(F.col("_b"), F.col("_b") - 1)).alias("_bk")).where(F.col("_bk") >= 0)
    nschema = "_gk string, _i long, _next long, _exit long, _m long"
    nx = cut_lineage(la.groupBy("_gk", "_bk").applyInPandas(_next_fn(limit, overhead, B), nschema))
    # step 3: block entries by pointer doubling over exit()
    nb_max = int(pre.agg(F.max("_b")).first()[0] or 0) + 1
    jump = nx.select("_gk", F.col("_i").alias("s"), F.col("_exit").alias("j"), "_m")
    entries = sizes.select("_gk", F.lit(0).cast("long").alias("_bk"), F.lit(0).cast("long").alias("_e"), "_m")
    k = 0
    while (1 << k) < nb_max:
        step = 1 << k
        adv = entries.join(jump.withColumnRenamed("s", "_e").drop("_m"), ["_gk", "_e"]) \
            .where(F.col("j") < F.col("_m")) \
            .select("_gk", (F.col("_bk") + step).alias("_bk"), F.col("j").alias("_e"), "_m")
        entries = cut_lineage(entries.unionByName(adv))
        if (2 << k) < nb_max:
            j2 = jump.join(jump.select("_gk", F.col("s").alias("j"), F.col("j").alias("j2")), ["_gk", "j"], "left")
            jump = cut_lineage(j2.select("_gk", "s", F.when(F.col("j") >= F.col("_m"), F.col("j"))
                                         .otherwise(F.col("j2")).alias("j"), "_m"))
        k += 1
    # step 4: starts within each block from its entry; window numbers
    # a last, partial block may hold no start (a window from the block before runs to the end)
    blk = nx.withColumn("_bk", F.floor(F.col("_i") / B).cast("long")).join(
        entries.select("_gk", "_bk", "_e"), ["_gk", "_bk"], "left").fillna({"_e": -1})
    st = cut_lineage(blk.groupBy("_gk", "_bk").applyInPandas(
        _starts_fn(B), "_gk string, _bk long, _i long, _lw long"))
    per_block = st.groupBy("_gk", "_bk").agg(F.max("_lw").alias("_nw"))
    offs = group_prefix(per_block, ["_gk"], ["_bk"], "_nw").select(
        "_gk", "_bk", (F.col("_cum") - F.col("_nw")).alias("_wo"))
    win = st.join(offs, ["_gk", "_bk"]).select("_gk", "_i", (F.col("_wo") + F.col("_lw") - 1).alias("window"))
    return pre.select("_rid", "_gk", "_i").join(win, ["_gk", "_i"]).select("_rid", "window")


def null_safe_join(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` with nulls equal; the key columns come from ``a``."""
    if not keys:
        return a.join(b.withColumn("_one", F.lit(1)), F.lit(1) == F.col("_one"), how).drop("_one")
    r = b.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    cond = None
    for k in keys:
        c = a[k].eqNullSafe(F.col(f"_r_{k}"))
        cond = c if cond is None else cond & c
    return a.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds a 0-based row number by ``order`` (ties in any order, the same for every reader: rows are written)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = cut_lineage(df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()))
    before = cut.groupBy("_p").count().withColumn(
        "_before", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    out = cut.withColumn(name, local).join(F.broadcast(before.drop("count")), "_p") \
        .withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_p", "_before")
    return cut_lineage(out, replaces=cut)


def running(df: DataFrame, by: list[str], order: list[str], **scans: tuple) -> DataFrame:
    """Adds inclusive running values, ``name=("sum" | "max", column)``, within groups of any size: rows are range
    partitioned, scanned per partition, and groups that cross partitions carry their totals over (at most one
    row per partition border, broadcast).  A scan may use the names of the scans before it."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = cut_lineage(df.repartitionByRange(parts, *by, *order).withColumn("_p", F.spark_partition_id()))
    local = Window.partitionBy("_p", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    for name, (kind, column) in scans.items():
        fn = {"sum": F.sum, "max": F.max}[kind]
        carry = out.groupBy(*by, "_p").agg(fn(column).alias("_t")) \
            .select(*by, "_p", F.count("*").over(earlier).alias("_n"), fn("_t").over(earlier).alias("_c")).where("_n > 0").drop("_n")
        out = out.withColumn(name, fn(column).over(local)).join(F.broadcast(carry), [*by, "_p"], "left")
        both = F.col(name) + F.coalesce("_c", F.lit(0)) if kind == "sum" else F.greatest(name, "_c")
        out = out.withColumn(name, both).drop("_c")
    return out.drop("_p")
