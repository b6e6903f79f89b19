"""Mixing overlapping sources to target weights by min-cost flow.

1. Spark aggregates documents by membership pattern (the sorted set of sources
   a document belongs to): only one row per pattern reaches the driver.  Their
   number is a property of the source catalogue, not of the corpus.
2. ``fill_targets`` shares all tokens by weight, with targets stopped at
   ``max_repeat`` times what their source holds.
3. ``min_cost_flow`` routes token capacity from patterns to source quotas.  The
   r-th use of a pattern's tokens costs r * r, so repetition is spread evenly;
   the graph has one node per pattern and source.
4. A pattern's flow is q whole passes over its documents plus a rest.  The rest
   goes to the documents with the smallest seeded hash: per pattern a threshold
   is found by refining histograms of the hash, 12 bits a round, so that no
   pattern is ever sorted or gathered.  The group of equal hashes at the
   threshold is taken if that comes nearer.

Reruns agree: the hash depends on the document id and the seed only.  Defined
results: null or empty texts have size 0 and are never taken; null sources
count as a source of their own, ordered last; rows repeating an id share their
hash and so their fate; an empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BITS, ROUNDS = 12, 3          # 36 hash bits decide the order
CYCLE = (5, 2, 1)


def word_count(text: str | Column) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def seeded_hash(c: Column, seed: int) -> Column:
    """36 bits of the MD5 of ``seed:id`` (null ids: the empty string)."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(c.cast("string"), F.lit(""))))
    return F.conv(F.substring(h, 1, 9), 16, 10).cast("long")


def fill_targets(total: float, sizes: Sequence[int], weights: Sequence[float], max_repeat: int) -> list[float]:
    """Shares of ``total`` by weight, none above ``max_repeat`` times its size: sources that
    are full keep their cap, the excess is shared anew among the others until none is above."""
    caps = [float(max_repeat * s) for s in sizes]
    full: set[int] = set()
    while True:
        left = total - sum(caps[i] for i in full)
        w = sum(weights[i] for i in range(len(sizes)) if i not in full)
        level = left / w if w else 0.0
        over = {i for i in range(len(sizes)) if i not in full and level * weights[i] > caps[i]}
        if not over:
            return [caps[i] if i in full else level * weights[i] for i in range(len(sizes))]
        full |= over


def min_cost_flow(capacity: Sequence[int], members: Sequence[Sequence[int]], quota: Sequence[int],
                  max_repeat: int) -> list[int]:
    """Tokens to take from each pattern: cheapest flow that fills as much of the quotas as it can.

    Successive cheapest paths over pattern passes -> patterns -> sources; a path leads from a
    pattern with a free pass, over sources that can hand flow back, to a source below its quota.
    Each path empties a pass, fills a quota or exhausts a hand-back.
    """
    taken, got = [0] * len(capacity), [0] * len(quota)
    flow: dict[tuple[int, int], int] = {}
    holders: dict[int, list[int]] = {}
    for p, ss in enumerate(members):
        for s in ss:
            holders.setdefault(s, []).append(p)

    def passes(p):                      # (cost of the next token, how many at that cost)
        if not capacity[p] or taken[p] >= max_repeat * capacity[p]:
            return None
        r = taken[p] // capacity[p] + 1
        return r * r, r * capacity[p] - taken[p]

    while True:
        starts = sorted((c[0], p) for p in range(len(capacity)) if (c := passes(p)))
        path = None
        seen_p: set[int] = set()
        for _, start in starts:         # moves between patterns are free: the first that reaches an open quota is cheapest
            if start in seen_p:
                continue
            back, queue, end = {start: None}, [start], None
            seen_p.add(start)
            seen_s: dict[int, int] = {}
            while queue and end is None:
                p = queue.pop(0)
                for s in members[p]:
                    if s in seen_s:
                        continue
                    seen_s[s] = p
                    if got[s] < quota[s]:
                        end = s
                        break
                    for q in holders[s]:
                        if q not in back and flow.get((q, s), 0) > 0:
                            back[q] = s
                            queue.append(q)
            if end is not None:
                path, amount, s = [], min(quota[end] - got[end], passes(start)[1]), end
                while s is not None:
                    p = seen_s[s]
                    path.append((p, s, 1))
                    s = back[p]
                    if s is not None:
                        path.append((p, s, -1))
                        amount = min(amount, flow[(p, s)])
                break
        if path is None:
            return taken
        for p, s, sign in path:
            flow[(p, s)] = flow.get((p, s), 0) + sign * amount
        taken[start] += amount
        got[end] += amount


def _thresholds(sized: DataFrame, rest: DataFrame) -> DataFrame:
    """``(pattern, lim, take_at)``: extra documents are those with hash < lim, and those with
    hash = lim where ``take_at``.  ``rest`` is (pattern, rest), tokens beyond the whole passes."""
    shift = BITS * ROUNDS
    state = rest.select("pattern", F.col("rest").alias("need"), F.lit(0).cast("long").alias("prefix"))
    for r in range(ROUNDS):
        shift -= BITS
        rows = sized.where("size > 0").join(F.broadcast(state), "pattern")
        if r:
            rows = rows.where(F.shiftright("u", shift + BITS) == F.col("prefix"))
        hist = rows.groupBy("pattern", F.shiftright("u", shift).alias("bin")).agg(F.sum("size").alias("s"), F.max("need").alias("need"))
        w = Window.partitionBy("pattern").orderBy("bin")
        cum = hist.withColumn("upto", F.sum("s").over(w))
        # the bin in which the running total passes the need
        hit = cum.where(F.col("upto") > F.col("need")).groupBy("pattern").agg(F.min(F.struct("bin", "upto", "s", "need")).alias("h"))
        state = hit.select("pattern", (F.col("h.need") - (F.col("h.upto") - F.col("h.s"))).alias("need"),
                           F.col("h.bin").alias("prefix"), F.col("h.s").alias("s"))
        state = _small(state)
    return state.select("pattern", F.col("prefix").alias("lim"), (F.col("s") - F.col("need") < F.col("need")).alias("take_at"))


def _small(df: DataFrame) -> DataFrame:
    """A table of one row per pattern, computed once."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def _pattern() -> Column:
    """Key of a membership pattern (the column ``sources``)."""
    return F.sha2(F.concat_ws("\x01", F.transform("sources", lambda s: F.coalesce(s, F.lit("\x00null")))), 256)


def plan_mix(sized: DataFrame, max_repeat: int = 3, cycle: Sequence[float] = CYCLE) -> DataFrame:
    """``sized``: a stored table of (u, size, sources array<string>), u from ``seeded_hash``.  One row per
    membership pattern: ``(pattern, passes, lim, take_at, source_size, target)``; the last two are those
    of its first source.  Weights follow ``cycle`` over the sources by code point, null last."""
    spark = sized.sparkSession
    keyed = sized.select("u", "size", "sources", _pattern().alias("pattern"))
    rows = keyed.groupBy("pattern").agg(F.sum("size").alias("size"), F.max("sources").alias("sources")).collect()
    names = sorted({s for r in rows for s in r["sources"]}, key=lambda s: (s is None, s.encode() if s is not None else b""))
    at = {s: i for i, s in enumerate(names)}
    members = [[at[s] for s in r["sources"]] for r in rows]
    sizes = [0] * len(names)
    for r, ss in zip(rows, members):
        for s in set(ss):
            sizes[s] += r["size"]
    weights = [float(cycle[i % len(cycle)]) for i in range(len(names))]
    targets = fill_targets(float(sum(r["size"] for r in rows)), sizes, weights, max_repeat)
    taken = min_cost_flow([r["size"] for r in rows], members, [int(t + 0.5) for t in targets], max_repeat)
    plan = [(r["pattern"], t // r["size"] if r["size"] else 0, t % r["size"] if r["size"] else 0,
             sizes[m[0]] if m else 0, targets[m[0]] if m else 0.0) for r, t, m in zip(rows, taken, members)]
    quotas = spark.createDataFrame(plan, "pattern string, passes long, rest long, source_size long, target double")
    lim = _thresholds(keyed.select("pattern", "u", "size"), quotas.select("pattern", "rest"))
    return _small(quotas.join(lim, "pattern", "left").select("pattern", "passes", "lim", "take_at", "source_size", "target"))


def apply_mix(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with columns u, size and sources: adds ``source_size``, ``target`` and ``times``."""
    extra = F.coalesce((F.col("u") < F.col("lim")) | ((F.col("u") == F.col("lim")) & F.col("take_at")), F.lit(False))
    times = F.when(F.col("size") > 0, F.col("passes") + F.when(extra, 1).otherwise(0)).otherwise(0)
    return rows.withColumn("pattern", _pattern()).join(F.broadcast(plan), "pattern") \
        .withColumn("times", times).drop("pattern", "passes", "lim", "take_at")
