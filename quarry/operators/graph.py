"""Graph building block: connected components (used by DBSCAN and HDBSCAN).

``connected_components`` contracts an edge DataFrame round by round; every round
is a table in the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import cut_lineage, drop_lineage


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` with component = smallest node id of the component.

    Contraction: every root takes the smallest root next to it (two pointer jumps deep), edges are
    rewritten to roots, loops and doubles go.  At least half of the roots with an edge vanish per
    round, so the rounds are logarithmic and their tables shrink; they end when no edge is left.
    The smallest node of a component never moves.  Nodes may be of any orderable type; superseded
    tables are deleted.
    """
    e = edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).where(F.col("a") != F.col("b")).distinct()
    e = cut_lineage(e)
    both = e.select("a").unionByName(e.select(F.col("b").alias("a")))
    label = cut_lineage(both.distinct().select(F.col("a").alias("node"), F.col("a").alias("root")))
    while e.limit(1).count():
        near = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) \
            .groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("root"), F.least("a", "m").alias("to"))
        hook = cut_lineage(near)
        for _ in range(2):
            up = hook.select(F.col("root").alias("to"), F.col("to").alias("next"))
            hook = cut_lineage(hook.join(up, "to").select("root", F.col("next").alias("to")), replaces=hook)
        label = cut_lineage(label.join(hook, "root", "left").select("node", F.coalesce("to", "root").alias("root")), replaces=label)
        ea = hook.select(F.col("root").alias("a"), F.col("to").alias("ra"))
        eb = hook.select(F.col("root").alias("b"), F.col("to").alias("rb"))
        moved = e.join(ea, "a").join(eb, "b").where(F.col("ra") != F.col("rb")) \
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        e = cut_lineage(moved, replaces=e)
        drop_lineage(hook)
    drop_lineage(e)
    return label.select("node", F.col("root").alias("component"))
