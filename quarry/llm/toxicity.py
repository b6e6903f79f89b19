"""Toxicity by nearest labelled examples: exact TF-IDF cosine over all terms of the texts.

Fitting uses a bounded sample (``MAX_EXAMPLES`` labelled ids of each class), all of it searched:

* every term counts, under one of ``BUCKETS`` hashes; its IDF comes from the
  document frequencies over all documents;
* terms over-represented in toxic examples by the G statistic (from ``MIN_G``
  on) weigh ``1 + log(1 + G)`` times as much; near copies (the same smallest
  shingle) are one witness.  The others keep their plain weight: none is left out;
* the examples' unit vectors; the columns of the most frequent terms are kept
  dense, the others as postings.

A text's cosines with all examples are a product of the dense columns (of
``BLOCK`` texts at once) and sums over the postings of its other terms; those
that can be among the k largest are computed again in one summation order, so
the k neighbours are exact and do not depend on batches.  Votes weigh the
squared cosine and how many labelled rows of its class an example stands for;
a logistic map fitted on left-one-out votes of the examples turns the vote
into a calibrated score.  The nearest examples come along as evidence.

The model holds the terms of at most ``2 * MAX_EXAMPLES`` texts, whatever the corpus.
Defined results: a text without a term of any example (null and empty texts too)
has no neighbour; its score is the base rate among examples without a term.  Without
labelled rows of both classes every score is the smoothed base rate.  Terms are
runs of letters, lower-cased; whole texts count.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.labelled import labelled_sample
from quarry.llm.shingles import mix, sets

MAX_EXAMPLES, BUCKETS, MIN_G, MIN_DF = 4000, 1 << 20, 20.0, 3
BLOCK, DENSE, NEIGHBOURS, CHUNK = 64, 512, 15, 1 << 18
_POWERS = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15, np.uint64))
_WORD = re.compile(r"[^\W\d_]+")
EVIDENCE = "array<struct<doc_id: bigint, cosine: double, label: int>>"


def _letters() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    for m in _WORD.finditer("".join(map(chr, range(0x110000)))):
        table[m.start():m.end()] = True
    return table


_LETTER = _letters()


def _parts(texts) -> Iterator[list[tuple[int, str]]]:
    """The lower-cased texts with their places, in lists of about ``CHUNK`` characters; a longer text is cut at
    white space where there is any in reach."""
    part, size = [], 0
    for i, t in enumerate(texts):
        t = (t or "").lower()
        at = 0
        while at < len(t):
            end = len(t)
            if end - at > CHUNK:
                end = max(t.rfind(" ", at, at + CHUNK), t.rfind("\n", at, at + CHUNK)) + 1
                end = end if end > at else at + CHUNK
            part.append((i, t[at:end]))
            size += end - at
            at = end
            if size >= CHUNK:
                yield part
                part, size = [], 0
    if part:
        yield part


def _keys(part: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``place * BUCKETS + bucket`` of the terms of a list, in order, and how often each occurs."""
    data = np.frombuffer("\n".join(t for _, t in part).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTER[data]
    edge = np.flatnonzero(np.diff(letter.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, length = edge[::2], edge[1::2] - edge[::2]
    if not start.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.cumsum(length) - length
    pos = np.arange(first[-1] + length[-1]) - np.repeat(first, length)
    h = np.add.reduceat((data[letter].astype(np.uint64) + np.uint64(1)) * _POWERS[pos & 4095], first)
    bucket = (mix(h + length.astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)
    ends = np.cumsum([len(t) + 1 for _, t in part])
    place = np.array([i for i, _ in part])[np.searchsorted(ends, start, side="right")]
    return np.unique(place * BUCKETS + bucket, return_counts=True)


def counts(texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text the distinct buckets of its terms in order, and how often each occurs."""
    out = [(np.zeros(0, np.int32), np.zeros(0))] * len(texts)
    for part in _parts(texts):
        key, n = _keys(part)
        place, bucket = key // BUCKETS, (key % BUCKETS).astype(np.int32)
        cut = np.flatnonzero(np.diff(place, prepend=-1))
        for lo, hi in zip(cut, np.append(cut[1:], key.size)):
            at, m = bucket[lo:hi], n[lo:hi].astype(np.float64)
            if out[place[lo]][0].size:                       # a further piece of a long text
                both = np.concatenate([out[place[lo]][0], at])
                m = np.concatenate([out[place[lo]][1], m])
                at, where = np.unique(both, return_inverse=True)
                m = np.bincount(where, m)
            out[place[lo]] = at, m
    return out


def _runs(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The positions of runs that begin at ``first``, one run after the other."""
    return np.arange(length.sum()) + np.repeat(first - np.cumsum(length) + length, length)


def _pair(v) -> tuple[np.ndarray, np.ndarray]:
    if not isinstance(v, dict):
        return v
    at = sorted(v)
    return np.array(at, np.int32), np.array([v[t] for t in at], np.float64)


class Index:
    """Unit vectors by row and by term; rows are examples.  A vector is a dict or (terms, weights)."""

    def __init__(self, vectors: list, n_terms: int, block: int = BLOCK, dense: int = DENSE):
        vectors = [_pair(v) for v in vectors]
        self.n, self.block = len(vectors), block
        known, term = np.unique(np.concatenate([t for t, _ in vectors]), return_inverse=True)
        term = term.astype(np.int32)
        order = np.argsort(term, kind="stable")
        self.post_rows = np.repeat(np.arange(self.n, dtype=np.int32), [t.size for t, _ in vectors])[order]
        self.post_weights = np.concatenate([w for _, w in vectors])[order]
        self.post_size = np.bincount(term)                   # of the postings of a term
        self.code = np.full(n_terms, -1, np.int32)           # of a term that an example holds
        self.code[known] = np.arange(known.size)
        self.often = np.argsort(-self.post_size, kind="stable")[:dense]
        self._lay_out()

    def _lay_out(self) -> None:
        """The dense columns, made from the postings wherever the index arrives."""
        self.slot = np.full(self.post_size.size, -1, np.int32)      # of a term among the dense columns
        self.slot[self.often] = np.arange(self.often.size)
        at = np.repeat(self.slot, self.post_size)
        self.dense = np.zeros((self.n, self.often.size))
        self.dense[self.post_rows[at >= 0], at[at >= 0]] = self.post_weights[at >= 0]
        self.single = self.dense.astype(np.float32)
        self.first = np.cumsum(self.post_size) - self.post_size
        self.size = np.where(self.slot < 0, self.post_size, 0)      # of the postings to go through

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("slot", "dense", "single", "first", "size")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._lay_out()

    def _known(self, q) -> tuple[np.ndarray, np.ndarray]:
        t, w = _pair(q)
        at = np.where(t < self.code.size, self.code[np.minimum(t, self.code.size - 1)], -1)
        return at[at >= 0], w[at >= 0]

    def nearest(self, q, k: int, skip: int = -1) -> list[tuple[float, int]]:
        """The k largest cosines > 0 as (cosine, row), ties by row; ``skip`` leaves one row out."""
        return self.nearest_all([q], k, [skip])[0]

    def nearest_all(self, queries: list, k: int, skip=None) -> list[list[tuple[float, int]]]:
        out = []
        for lo in range(0, len(queries), self.block):
            part = [self._known(q) for q in queries[lo:lo + self.block]]
            wide = np.zeros((len(part), self.dense.shape[1]))
            for i, (t, w) in enumerate(part):
                s = self.slot[t]
                wide[i, s[s >= 0]] = w[s >= 0]
            near = wide.astype(np.float32) @ self.single.T
            for i, (t, w) in enumerate(part):
                size = self.size[t]
                at = _runs(self.first[t], size)
                rest = np.bincount(self.post_rows[at], self.post_weights[at] * np.repeat(w, size), self.n)
                out.append(self._exact(near[i] + rest, rest, wide[i], k, -1 if skip is None else skip[lo + i]))
        return out

    def _exact(self, near: np.ndarray, rest: np.ndarray, wide: np.ndarray, k: int, skip: int) -> list[tuple[float, int]]:
        """Of rows whose cosine with single-precision products reaches the k-th largest, the cosines row by row."""
        if 0 <= skip < self.n:
            near[skip] = 0
        kth = np.partition(near, -k)[-k] if self.n >= k else 0.0
        rows = np.flatnonzero((near >= kth - 1e-5) & (near > 0))
        cos = (self.dense[rows] * wide).sum(1) + rest[rows]
        best = np.lexsort((rows, -cos))[:k]
        return [(float(cos[i]), int(rows[i])) for i in best if cos[i] > 1e-12]


class Model:
    """Everything a score needs; picklable, bounded.  ``weight`` is the weight of each bucket."""

    def __init__(self, base: float, weight: np.ndarray | None = None, ids=None, labels=None, texts=None,
                 class_weight=(1.0, 1.0), k: int = NEIGHBOURS):
        self.base, self.term_weight, self.k = base, weight, k
        self.a, self.b = 1.0, 0.0
        if not texts:
            self.index = None
            return
        self.ids, self.labels = ids, np.array(labels)
        self.weight = np.array([class_weight[y] for y in self.labels])
        vectors = [self.vector(*c) for c in texts]
        self.index = Index(vectors, weight.size)
        votes = np.array([self._vote(near) for near in self.index.nearest_all(vectors, k, range(len(vectors)))])
        self.a, self.b = _logistic(np.log(votes / (1 - votes)), self.labels, self.weight)

    def vector(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(n)) * self.term_weight[at]
        return at, w / (math.sqrt((w * w).sum()) or 1.0)

    def _vote(self, near) -> float:
        s, y = 0.5 * self.base, 0.5
        for c, i in near:
            s, y = s + self.weight[i] * c * c * self.labels[i], y + self.weight[i] * c * c
        return min(1 - 1e-6, max(1e-6, s / y))

    def score(self, text: str | None, evidence: int = 3):
        return self.scores([text], evidence)[0]

    def scores(self, texts, evidence: int = 3) -> list[tuple[float, list]]:
        if self.index is None:
            return [(self.base, []) for _ in texts]
        return [self._calibrated(near, evidence)
                for lo in range(0, len(texts), BLOCK)
                for near in self.index.nearest_all([self.vector(*c) for c in counts(texts[lo:lo + BLOCK])], self.k)]

    def _calibrated(self, near, evidence: int):
        if not near:
            return self.base, []
        v = self._vote(near)
        z = self.a * math.log(v / (1 - v)) + self.b
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), [
            {"doc_id": self.ids[i], "cosine": c, "label": int(self.labels[i])} for c, i in near[:evidence]]


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Weighted logistic regression on one input with a light ridge (Newton steps)."""
    beta, design = np.array([1.0, 0.0]), np.stack([x, np.ones_like(x)], 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (w * (p - y)) + 1e-2 * (beta - [1.0, 0.0])
        hess = (design * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta = beta - np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 0.0)), float(beta[1])


def document_frequency(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents and document frequency of each bucket, over all rows: each task sends one
    row per bucket it met."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, df = 0, np.zeros(BUCKETS, np.int64)
        for pdf in batches:
            n += len(pdf)
            for lo in range(0, len(pdf), BLOCK):
                for at, _ in counts(list(pdf["text"][lo:lo + BLOCK])):
                    df[at] += 1
        at = np.flatnonzero(df)
        yield pd.DataFrame({"t": np.append(at, -1).astype(np.int32), "n": np.append(df[at], n)})

    got = docs.select("text").mapInPandas(run, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    at, n = got["t"].to_numpy(), got["n"].to_numpy()
    out = np.zeros(BUCKETS)
    out[at[at >= 0]] = n[at >= 0]
    return int(n[at < 0].sum()), out


def over_represented(texts: list, labels: list[int], families: list[int]) -> np.ndarray:
    """The G statistic of each bucket that toxic examples hold more often than expected, else 0.  Copies of
    one text (the same family) are one witness for a term."""
    family, where = np.unique(families, return_inverse=True)
    who = where + family.size * np.asarray(labels)
    n0, n1 = (np.unique(where[np.asarray(labels) == y]).size for y in (0, 1))
    seen = np.unique(np.concatenate([at.astype(np.int64) * 2 * family.size + w for (at, _), w in zip(texts, who)]))
    toxic = seen % (2 * family.size) >= family.size
    c1, c0 = (np.bincount(seen[toxic == y] // (2 * family.size), minlength=BUCKETS) for y in (True, False))
    e1, e0 = (c1 + c0) * n1 / (n0 + n1), (c1 + c0) * n0 / (n0 + n1)

    def part(seen_n, expected):
        return np.where(seen_n > 0, seen_n * np.log(np.maximum(seen_n, 1) / np.where(seen_n > 0, expected, 1)), 0.0)
    g = 2 * (part(c1, e1) + part(c0, e0) + part(n1 - c1, n1 - e1) + part(n0 - c0, n0 - e0))
    return np.where((c1 > e1) & (c0 + c1 >= MIN_DF), g, 0.0)


def fit(docs: DataFrame, labels: DataFrame, keep, label: str = "toxic", max_examples: int = MAX_EXAMPLES,
        min_g: float = MIN_G) -> Model:
    @F.pandas_udf("struct<family: bigint, at: binary, n: binary>")
    def read(texts: pd.Series) -> pd.DataFrame:
        family = [int(s[:1].view(np.int64)[0]) if s.size else 0 for s in sets(list(texts))]
        c = counts(list(texts))
        return pd.DataFrame({"family": family, "at": [at.tobytes() for at, _ in c], "n": [n.astype(np.int32).tobytes() for _, n in c]})

    sizes = {r["y"]: r["n"] for r in labels.where(keep & F.col(label).isNotNull()).groupBy(F.col(label).alias("y"))
             .agg(F.count("*").alias("n")).collect()}
    rows = labelled_sample(docs, labels, label, keep, max_examples, per_class=True) \
        .select("doc_id", "y", read("text").alias("r")).select("doc_id", "y", "r.*").orderBy("doc_id").collect()
    per = Counter(r["y"] for r in rows)
    total = sizes.get(0, 0) + sizes.get(1, 0)
    rate = (sizes.get(1, 0) + 1) / (total + 2)
    if not per[0] or not per[1]:
        return Model(rate)
    weight = (sizes.get(0, 0) / per[0], sizes.get(1, 0) / per[1])
    plain = [r["y"] for r in rows if not r["at"]]
    w1, w0 = weight[1] * sum(plain), weight[0] * (len(plain) - sum(plain))
    base = (w1 + rate) / (w1 + w0 + 1)
    used = [r for r in rows if r["at"]]
    if not used:
        return Model(base)
    y = [r["y"] for r in used]
    ids, families = [r["doc_id"] for r in used], [r["family"] for r in used]
    texts = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["n"], np.int32)) for r in used]
    del rows, used
    g = over_represented(texts, y, families)
    n, df = document_frequency(docs)
    idf = np.log((1 + n) / (1 + df)) + 1
    return Model(base, idf * np.where(g >= min_g, 1 + np.log1p(g), 1.0), ids, y, texts, weight)


def scorer(model: Model):
    """A column function text -> struct(score, evidence)."""
    @F.pandas_udf(f"struct<score: double, evidence: {EVIDENCE}>")
    def score(texts: pd.Series) -> pd.DataFrame:
        out = model.scores(list(texts))
        return pd.DataFrame({"score": [s for s, _ in out], "evidence": [e for _, e in out]})
    return score
