"""Pitman-Yor model: seating against the exact posterior, counts against Python, probabilities that sum to 1."""

import math
import re
import zlib
from collections import Counter

import numpy as np

from quarry.llm import pitmanyor
from quarry.llm.labelled import fold
from quarry.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def partitions(n, largest=None):
    """Multisets of table sizes with the number of seatings of n customers that give them."""
    if n == 0:
        yield (), 1
        return
    for first in range(min(n, largest or n), 0, -1):
        for rest, _ in partitions(n - first, first):
            sizes = (first, *rest)
            ways = math.factorial(n)
            for s in sizes:
                ways //= math.factorial(s)
            for m in Counter(sizes).values():
                ways //= math.factorial(m)
            yield sizes, ways


def test_gibbs_steps_keep_the_exact_distribution_of_tables():
    c, new, d = 7, 1.3, 0.6
    weight = np.zeros(c + 1)
    for sizes, ways in partitions(c):
        w = ways * new ** len(sizes)
        for s in sizes:
            w *= np.prod([j - d for j in range(1, s)])
        weight[len(sizes)] += w
    want = weight / weight.sum()
    n = 20000
    seats = pitmanyor.Seating(np.full(n, c), np.full(n, new), d, 60, np.random.default_rng(4))
    for _ in range(60):
        seats.move(np.full(n, new))
        assert (np.add.reduceat(seats.size, seats.off) == c).all()
        assert (np.add.reduceat(seats.size > 0, seats.off, dtype=int) == seats.t).all()
    assert np.abs(np.bincount(seats.t, minlength=c + 1) / n - want).max() < 0.012


def log_stirling(c, d):
    """Logarithms of the generalised Stirling numbers S_d(c, t), t = 0..c."""
    row = np.full(c + 1, -np.inf)
    row[1] = 0.0
    for n in range(1, c):
        t = np.arange(c + 1)
        stay = row + np.log(np.maximum(n - d * t, 1e-300))
        row = np.logaddexp(np.where(t <= n, stay, -np.inf), np.append(-np.inf, row[:-1]))
    return row


def test_a_pass_takes_every_customer_once_in_bounded_steps():
    rng = np.random.default_rng(2)
    c, label = np.array([2, 900, 3, 40, 2]), np.array([0, 0, 1, 4, 4])
    seats = pitmanyor.Seating(c, np.full(5, 1.5), 0.6, 64, rng)
    steps = list(seats.turns(label))
    assert len(steps) == 64 and np.sort(np.concatenate([at for at, _ in steps])).tolist() == list(range(c.sum()))
    for at, dish in steps:
        assert (np.searchsorted(seats.off, at, "right") - 1 == dish).all() and (np.bincount(label[dish], minlength=5)[1:] <= 1).all()
        seats.leave(at, dish)
        seats.join(at, dish, np.full(at.size, 1.5))
    assert (np.add.reduceat(seats.size, seats.off) == c).all() and (np.bincount(seats.seat, minlength=c.sum()) == seats.size).all()
    assert (np.add.reduceat(seats.size > 0, seats.off, dtype=int) == seats.t).all()


def test_sweeps_over_large_dishes_keep_the_exact_distribution_of_tables():
    c, new, d, n = 300, 2.0, 0.5, 150
    want = log_stirling(c, d) + np.arange(c + 1) * math.log(new)
    want = np.exp(want - want.max())
    want /= want.sum()
    seats = pitmanyor.Seating(np.full(n, c), np.full(n, new), d, 64, np.random.default_rng(3), (np.ones(n), np.full(n, c)))
    got = np.zeros(c + 1)
    for i in range(150):
        for at, dish in seats.turns(np.arange(n)):
            seats.leave(at, dish)
            seats.join(at, dish, np.full(at.size, new))
        if i >= 50:
            got += np.bincount(seats.t, minlength=c + 1)
    t = np.arange(c + 1)
    mean = (got * t).sum() / got.sum()
    assert abs(mean - (want * t).sum()) < 0.3 and np.abs(np.cumsum(got / got.sum()) - np.cumsum(want)).max() < 0.05


def test_tables_and_the_parents_seats_keep_their_joint_distribution():
    """Two contexts of a word: tables that open and close move the parent's customers, and a state goes on."""
    n, c, strength, base, d0, d1 = 4000, (2, 4), (1.5, 2.5), 0.4, 0.6, 0.5
    totals = pitmanyor.Totals(6 * n, n, 10.0, 0.0, d0, d1, 1.0, *[np.zeros(1)] * 4)
    totals.base = lambda: base
    want = {}
    for a in range(1, c[0] + 1):
        for b in range(1, c[1] + 1):
            for s in range(1, a + b + 1):
                want[a, b, s] = math.exp(log_stirling(c[0], d1)[a] + log_stirling(c[1], d1)[b] + log_stirling(a + b, d0)[s]
                                         + a * math.log(strength[0] / 11) + b * math.log(strength[1] / 11) + s * math.log(base))
    total, got, state = sum(want.values()), Counter(), None
    for i in range(12):
        _, now, state = pitmanyor.gibbs(np.tile(c, n), np.repeat(np.arange(n), 2), np.tile([(x - 1) / d1 for x in strength], n),
                                        np.full(n, 2), np.full(n, -1.0), np.zeros(n), totals, 2, 1, np.random.default_rng(i), state)
        assert (state[0] == now).all() and state[3].sum() == now.sum()
        if i >= 4:
            got.update(zip(now[::2].astype(int), now[1::2].astype(int), state[2].tolist()))
    seen = sum(got.values())
    assert set(got) <= set(want) and max(abs(got[x] / seen - want[x] / total) for x in want) < 0.015


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    words, contexts = 30, 8
    c = rng.poisson(1.5, (contexts, words))
    c[:, 0] = 0
    u, w = np.nonzero(c)
    order = np.argsort(w, kind="stable")
    u, w = u[order], w[order]
    k0 = np.bincount(w, minlength=words)
    vocabulary = int((k0 > 0).sum())
    first = np.bincount(u, minlength=contexts).astype(float)
    totals = pitmanyor.Totals(int(c.sum()), vocabulary, float(k0.sum()), float(vocabulary), 0.7, 0.6, 1.0, *[np.zeros(1)] * 4)
    t, customers, above = pitmanyor.sample(c[u, w], w, first[u], k0, np.full(words, -1.0), np.zeros(words), totals, 4, 3, rng)
    assert (t >= 1).all() and (t <= c[u, w]).all() and np.allclose(customers, np.bincount(w, t, words))
    last = pitmanyor.Totals(int(c.sum()), vocabulary, customers.sum(), above.sum(), 0.7, 0.6, 1.0, *[np.zeros(1)] * 4)
    parent = last.parent(customers, above)
    unknown = last.base() / (last.strength + last.k)
    assert np.isclose(parent[k0 > 0].sum() + unknown, 1)
    tables = np.bincount(u, t, contexts)
    for x in range(contexts):
        p = (last.strength + last.d1 * tables[x]) * parent
        at = u == x
        p[w[at]] += c[x, w[at]] - last.d1 * t[at]
        p /= last.strength + c[x].sum()
        rest = (last.strength + last.d1 * tables[x]) * unknown / (last.strength + c[x].sum())
        assert np.isclose(p[k0 > 0].sum() + rest, 1)


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) + [None]


def check(rows, texts, held):
    """Counts and base scores by Python; ``texts`` and ``rows`` in the same order."""
    train = Counter()
    for text, h in zip(texts, held):
        if not h:
            train.update(tokens(text))
    n, v = sum(train.values()), len(train)
    for r, text, h in zip(rows, texts, held):
        t = tokens(text)
        base = sum(math.log10((train[x] + 1) / (n + v + 1)) for x in t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, len(t), sum(train[x] > 0 for x in t), n)
        assert abs(r["base_score"] - base) < 1e-7 * max(1, abs(base)) and r["score"] <= 1e-9


def test_query_counts_and_held_out_perplexity(spark):
    rows = QUERIES["op12_pitman_yor"](spark, SF).orderBy("doc_id").collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    held = [zlib.crc32(str(d["doc_id"]).encode()) % 7 == 2 for d in docs]
    assert [r["doc_id"] for r in rows] == [d["doc_id"] for d in docs]
    check(rows, [d["text"] for d in docs], held)
    by_fold = {r["held_out"]: r for r in pitmanyor.perplexity(spark.createDataFrame(rows)).collect()}
    assert by_fold[True]["perplexity"] < 0.6 * by_fold[True]["base_perplexity"]
    assert by_fold[False]["perplexity"] < by_fold[True]["perplexity"]


def test_small_chunks_and_spread_words_give_the_same_counts(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).repartition(3)
    keep = fold("doc_id", 7) != 2
    monkeypatch.setattr(pitmanyor, "SAMPLE", 1)                     # many words are spread over the groups
    some = pitmanyor.score_texts(docs, keep, chunk_tokens=2000).toPandas().set_index("doc_id")
    monkeypatch.setattr(pitmanyor, "frequent_words", lambda *a: np.array([pitmanyor.END]))
    none = pitmanyor.score_texts(docs, keep).toPandas().set_index("doc_id").loc[some.index]
    assert (some[["n_tokens", "n_known", "train_tokens"]] == none[["n_tokens", "n_known", "train_tokens"]]).all().all()
    assert np.allclose(some.base_score, none.base_score)
    assert np.abs((some.score - none.score) / some.n_tokens).max() < 0.05   # another random seating, the same model


def test_edge_rows(spark):
    long = "lorem Ipsum\t" * 40000
    rows = [(1, "a b a b"), (1, "a b"), (2, None), (3, ""), (None, "b  a\x0b"), (5, long), (6, "zzz"), (7, " \n ")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, score string, n_tokens int")
    from pyspark.sql import functions as F
    keep = F.when(F.col("text") == "zzz", F.lit(False)).otherwise(True)
    got = pitmanyor.score_texts(df, keep).collect()
    order = {(-1 if i is None else i, len(tokens(t))): (t, t == "zzz") for i, t in rows}
    assert len(got) == len(rows)
    picked = [order[(-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"])] for r in got]
    check(got, [t for t, _ in picked], [h for _, h in picked])
    nothing = pitmanyor.score_texts(df, F.lit(False)).collect()
    assert all(r["score"] == 0 and r["base_score"] == 0 and r["n_known"] == 0 for r in nothing)
    empty = pitmanyor.score_texts(df.where("false"), keep)
    assert empty.count() == 0 and "score" in empty.columns
    by_name = pitmanyor.score_texts(df.withColumn("doc_id", F.concat(F.lit("k"), "doc_id")), keep)
    assert by_name.where("doc_id = 'k5' AND n_tokens = 80001").count() == 1
