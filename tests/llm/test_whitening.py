"""Whitening: numpy on the repeated rows, edge rows."""

import math

import numpy as np
import pytest

from quarry.llm import whitening
from quarry.llm.queries import QUERIES


def frame(spark, rows, ddl="vec_id long, embedding array<double>"):
    return spark.createDataFrame(rows, ddl)


def test_query_against_numpy(spark):
    got = QUERIES["op11_whitening"](spark, "/root/testdata/sf0.001").toPandas()
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").toPandas().sort_values("vec_id")
    check(got, list(e.vec_id), e.embedding.tolist(), list(range(len(e))))


def check(got, ids, vectors, fit_rows):
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(int) + 100000
    fit = x[fit_rows]
    n, s = len(fit), fit.sum(0)
    value, vector = np.linalg.eigh(np.cov(fit.T, bias=True))
    z = (x - s / n) @ vector[:, ::-1] / np.sqrt(value[::-1])
    assert (got.n == n).all() and got.identity_error.max() < 1e-9
    dev = ((n * x - s) ** 2).sum(1)
    for k in range(min(8, x.shape[1])):
        part = got[got.component == k + 1].sort_values("vec_id", kind="stable")
        order = np.argsort(ids, kind="stable")
        assert list(part.vec_id) == [ids[i] for i in order]
        assert sorted(zip(part.vec_id, part.deviation)) == sorted(zip(ids, dev.tolist()))
        mine = np.array(sorted(zip(part.vec_id, part.whitened)))
        want = np.array(sorted(zip(ids, z[:, k])))
        if np.abs(mine[0, 1] - want[0, 1]) > 1e-6:
            want = np.array(sorted(zip(ids, -z[:, k])))
        assert np.allclose(mine, want, atol=1e-8)
        assert np.allclose(part.explained, value[::-1][k] / value.sum())


def test_multiplicities_count_and_weights_of_one(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 5)).round(2).tolist()
    vectors = base + [base[0]] * 30 + [base[3]] * 2
    ids = list(range(len(vectors)))
    df = frame(spark, list(zip(ids, vectors))).repartition(5)
    check(whitening.long_form(whitening.whiten(df)).toPandas(), ids, vectors, ids)
    one = whitening.long_form(whitening.whiten(df, weights="one")).toPandas()
    check(one, ids, vectors, list(range(12)))
    with pytest.raises(ValueError):
        whitening.whiten(df, weights="two")


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [3.0, 1.0]), (None, [0.5, 0.25]), (4, None), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]),
            (8, []), (9, [1.0, 2.0, 3.0]), (10, [1e300, 0.0])]
    df = spark.createDataFrame([(*r, "k", 0) for r in rows], "vec_id long, embedding array<double>, key string, x int")
    got = whitening.long_form(whitening.whiten(df)).toPandas()
    assert sorted(got.vec_id.fillna(-1)) == [-1, -1, 1, 1, 1, 1] and set(got.n) == {3} and set(got.component) == {1, 2}
    assert got.identity_error.max() < 1e-9
    # no variance: whitened is null, the rows stay
    flat = whitening.long_form(whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]))).toPandas()
    assert len(flat) == 4 and flat.whitened.isna().all() and (flat.deviation == 0).all() and flat.identity_error.isna().all()
    for empty in (frame(spark, []), frame(spark, [(1, None)])):
        out = whitening.long_form(whitening.whiten(empty))
        assert out.count() == 0 and out.columns == whitening.long_form(whitening.whiten(df)).columns


def test_exact_deviation_beyond_64_bits(spark):
    rows = [(1, [3e9, 0.0]), (2, [-2e9, 1.0]), (3, [7.0, -4e9])]
    got = whitening.long_form(whitening.whiten(frame(spark, rows))).toPandas().set_index(["vec_id", "component"])
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x)]
    for (i, _), v in zip(rows, x):
        want = sum((3 * a - b) ** 2 for a, b in zip(v, s))
        assert got.loc[(i, 1)].deviation_exact == str(want) and want > 2 ** 63 and math.isnan(got.loc[(i, 1)].deviation)
