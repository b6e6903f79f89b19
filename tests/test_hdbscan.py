"""HDBSCAN against a sequential version written from the definition: heights, sizes, stabilities, labels, grids."""

import math

import numpy as np
import pytest

from quarry.operators import hdbscan as H
from quarry.operators import sequence, spatial


def sequential(points, mcs, ms, max_size=None, eps=0.0):
    """Labels (smallest index of the cluster, -1) by Kruskal, a binary merge tree and recursion over clusters."""
    n = len(points)
    if n < ms:
        return [-1] * n
    d = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(-1))
    core = np.sort(d, 1)[:, ms - 1]
    pairs = sorted((max(core[a], core[b], d[a, b]), d[a, b], a, b) for a in range(n) for b in range(a + 1, n))
    tree, members = {}, {i: [i] for i in range(n)}
    at = list(range(n))
    for m, _, a, b in pairs:
        if at[a] != at[b]:
            new = n + len(tree)
            tree[new] = (m, at[a], at[b])
            members[new] = members[at[a]] + members[at[b]]
            for p in members[new]:
                at[p] = new
    if not tree:
        return [-1] * n
    root = max(tree)
    clusters = []                                              # parent, birth height, points, stability, children

    def walk(node, parent, birth):
        me = len(clusters)
        start = 0.0 if parent is None else 1 / max(birth, 1e-12)
        clusters.append([parent, birth, set(members[node]), 0.0, []])
        if parent is not None:
            clusters[parent][4].append(me)
        while True:
            m, left, right = tree[node]
            lam = 1 / max(m, 1e-12)
            heavy = [c for c in (left, right) if len(members[c]) >= mcs]
            if len(heavy) == 1:
                clusters[me][3] += (lam - start) * (len(members[node]) - len(members[heavy[0]]))
                node = heavy[0]
                continue
            clusters[me][3] += (lam - start) * len(members[node])
            for c in heavy:
                walk(c, me, m)
            return

    if len(members[root]) >= mcs:
        walk(root, None, None)
    value, chosen = [0.0] * len(clusters), set()
    for i in reversed(range(len(clusters))):
        parent, _, pts, stability, kids = clusters[i]
        below = sum(value[k] for k in kids)
        if parent is not None and below <= stability and (max_size is None or len(pts) <= max_size):
            value[i] = stability
            todo = list(kids)
            while todo:
                k = todo.pop()
                chosen.discard(k)
                todo += clusters[k][4]
            chosen.add(i)
        else:
            value[i] = below
    final = set()
    for i in chosen:
        while eps and clusters[i][1] < eps and clusters[i][0] != 0:
            i = clusters[i][0]
            if clusters[i][1] > eps:
                break
        final.add(i)
    out = [-1] * n
    for i in sorted(final):
        for p in clusters[i][2]:
            out[p] = min(clusters[i][2]) if out[p] == -1 else min(out[p], min(clusters[i][2]))
    return out


def frame(spark, points):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "id long, x double, y double").repartition(4)


def blobs(rng, n):
    centres = rng.uniform(-3, 3, (5, 2))
    return np.vstack([rng.normal(centres[rng.integers(5)], rng.choice([0.1, 0.3, 0.8]), 2) for _ in range(n)])


def labels(df):
    return [r["cluster"] for r in df.orderBy("id").collect()]


def test_core_distances_and_tree_against_brute_force(spark):
    rng = np.random.default_rng(5)
    points = np.vstack([blobs(rng, 90), np.repeat([[0.5, 0.5]], 12, 0), [[2.0, 2.0]] * 3, np.column_stack([np.zeros(15), np.arange(15)])])
    df = frame(spark, points)
    d = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(-1))
    near = np.sort(d, 1)
    got = {(r["id"], r["k"]): r["core"] for r in H.core_distances(df, [2, 5, 200], key="id", x="x", y="y", tile_size=8).collect()}
    for i in range(len(points)):
        assert got[(i, 2)] == near[i, 1] and got[(i, 5)] == near[i, 4] and got[(i, 200)] is None
    edges, rounds = H.spanning_trees(df, [2, 5, 200], key="id", x="x", y="y", tile_size=8)
    rows = edges.collect()
    for ms in (2, 5):
        core = near[:, ms - 1]
        m = np.maximum(np.maximum(core[:, None], core[None, :]), d)
        todo = sorted((m[a, b], d[a, b], a, b) for a in range(len(points)) for b in range(a + 1, len(points)))
        at, want = list(range(len(points))), []
        for e in todo:
            a, b = at[e[2]], at[e[3]]
            if a != b:
                want.append(e)
                at = [a if c == b else c for c in at]
        assert sorted(tuple(r["e"]) for r in rows if r["k"] == ms) == want
    assert not any(r["k"] == 200 for r in rows)


@pytest.mark.parametrize("seed,n,tile", [(1, 120, 16), (2, 200, 512), (3, 60, 4)])
def test_grid_of_settings_equals_the_sequential_version(spark, seed, n, tile):
    points = blobs(np.random.default_rng(seed), n)
    configs = [{"config_id": i, "min_cluster_size": mcs, "min_samples": ms, "max_cluster_size": mx, "cluster_selection_epsilon": eps}
               for i, (mcs, ms, mx, eps) in enumerate([(3, 3, None, 0.0), (3, 3, 15, 0.3), (5, 3, None, 0.2), (10, 5, 40, 0.05), (5, 5, 25, 0.5),
                                                       (15, 1, None, 0.1), (2, 2, None, 0.0), (5, 10, None, 5.0)])]
    got = H.cluster_grid(frame(spark, points), configs, id_col="id", x="x", y="y", tile_size=tile).toPandas()
    for c in configs:
        mine = got[got.config_id == c["config_id"]].sort_values("id").cluster.tolist()
        assert mine == sequential(points, c["min_cluster_size"], c["min_samples"], c["max_cluster_size"], c["cluster_selection_epsilon"]), c


def test_places_of_many_copies_and_long_chains(spark):
    points = np.vstack([np.repeat([[0.0, 0.0]], 60, 0), np.repeat([[4.0, 0.0]], 8, 0),
                        np.column_stack([10 + np.cumsum(1.01 ** np.arange(60)) / 10, np.zeros(60)])])
    assert labels(H.hdbscan(frame(spark, points), id_col="id", x="x", y="y", min_cluster_size=5, min_samples=3, tile_size=8)) \
        == sequential(points, 5, 3)
    one = np.repeat([[1.0, 1.0]], 9, 0)
    assert labels(H.hdbscan(frame(spark, one), id_col="id", x="x", y="y", min_cluster_size=3, min_samples=2)) == [-1] * 9


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(9)
    points = np.vstack([rng.normal(0, 0.1, (20, 2)), rng.normal(3, 0.1, (20, 2))])
    rows = [(f"u{i:02d}", float(a), float(b), 1) for i, (a, b) in enumerate(points)]
    rows += [("n1", None, 1.0, 1), ("n2", nan, 0.0, 1), ("n3", 0.0, inf, 1), (None, 3.0, 3.0, 1), ("u00", 0.0, 0.0, 1)]
    df = spark.createDataFrame(rows, "id string, x double, y double, tile int")
    got = H.hdbscan(df, id_col="id", x="x", y="y", min_cluster_size=5, min_samples=3).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append(r["cluster"])
    assert by["n1"] == by["n2"] == by["n3"] == ["-1"] and by["u00"] == ["u00", "u00"] and by[None] == ["u20"] and by["u39"] == ["u20"]
    few = H.hdbscan(df.limit(2), id_col="id", x="x", y="y", min_cluster_size=5, min_samples=3)
    assert [r["cluster"] for r in few.collect()] == ["-1", "-1"]
    assert H.hdbscan(df.where("false"), id_col="id", x="x", y="y").count() == 0
    with pytest.raises(ValueError):
        H.hdbscan(df, id_col="id", x="x", y="y", min_cluster_size=1)


def test_running_values_cross_partitions(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 = 0 AS hot", "CAST(id % 7 AS DOUBLE) AS v").selectExpr("IF(hot, 0, id % 50) AS g", "id", "v")
    got = sequence.running(df, ["g"], ["id"], s=("sum", "v"), m=("max", "v")).toPandas().sort_values(["g", "id"])
    assert (got.s == got.groupby("g").v.cumsum()).all() and (got.m == got.groupby("g").v.cummax()).all()
    numbers = sequence.numbered(df, ["g", "id"], "i").toPandas().sort_values(["g", "id"])
    assert numbers.i.tolist() == list(range(1000))


def test_box_search_is_complete(spark):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(300, 2))
    spots, boxes = spatial.tiles(spatial.places(frame(spark, points), "id", "x", "y"), 16)
    rows = spots.toPandas()
    assert len(rows) == 300 and rows.groupby("tile").size().max() <= 20 and math.isclose(len(boxes.tile), 300 / 16, rel_tol=0.4)
    x, y, r = rng.normal(size=50), rng.normal(size=50), rng.uniform(0, 1, 50)
    p, t = boxes.within(x, y, r, closed=True)
    found = set(zip(p.tolist(), boxes.tile[t].tolist()))
    for i in range(50):
        near = rows[np.hypot(rows.x - x[i], rows.y - y[i]) <= r[i]]
        assert {(i, int(tile)) for tile in near.tile} <= found


def test_few_tiles_are_many_tasks(spark, monkeypatch, tmp_path):
    """Tiles are a few kilobytes and much work: adaptive merging may not put them into one task."""
    from quarry.operators import hdbscan as H
    from pyspark import TaskContext
    where, settle = str(tmp_path), H._settle

    def marked(boxes):
        run = settle(boxes)

        def fn(pdf):
            open(f"{where}/{TaskContext.get().partitionId()}", "a").close()
            return run(pdf)
        return fn
    monkeypatch.setattr(H, "_settle", marked)
    pts = spark.range(400).selectExpr("id", "rand(5) AS x", "rand(6) AS y")
    assert H.spanning_tree(pts, id_col="id", x="x", y="y", min_samples=3, tile_size=20).count() == 399
    assert len(list(tmp_path.iterdir())) > 3
