"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed once per text inside an Arrow-batched UDF (byte
histogram, word and line counts of the whole text).  The trees are fitted on
the statistics of a bounded sample of labelled rows (``MAX_TRAIN`` ids, chosen
by hash): quantile bins, all nodes of a level grown from one histogram each of
gradients and hessians.  A fitted model is three arrays per tree in heap order,
and scoring moves all rows of a batch through all trees a level at a time.

Defined results: null text counts as the empty text; with no labelled row, or
rows of one class only, every score is the smoothed base rate; an empty table
gives an empty result.  Other columns are never read.
"""

from __future__ import annotations

import operator
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.labelled import labelled_sample

MAX_TRAIN = 20_000
_CLASSES = [(b"!",), (b"?",), (b"|",), (b".,;:",), (b"#$%&*@^~=+<>",), (b"0123456789",), (b" \t",), (b"\n",),
            (bytes(range(65, 91)),), (bytes(range(97, 123)),), (bytes(range(128, 256)),), (b"()[]{}\"'/\\_-",)]
N_FEATURES = len(_CLASSES) + 10


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, raw.size)
    hist = np.bincount(raw, minlength=256)
    words, lines = text.split(), text.split("\n")
    w, k = max(1, len(words)), len(lines)
    share = hist[hist > 0] / n
    upper, lower = int(hist[65:91].sum()), int(hist[97:123].sum())
    same_next = sum(map(operator.eq, words, words[1:]))
    return [int(hist[list(c[0])].sum()) / n for c in _CLASSES] + [
        float(np.log1p(raw.size)), float(np.log1p(len(words))), raw.size / w, len(set(words)) / w,
        same_next / w, max(map(len, words), default=0), len(set(lines)) / k, raw.size / k,
        upper / max(1, upper + lower), float(-(share * np.log2(share)).sum())]


class Trees:
    """Flattened boosted trees: arrays (tree, node) of feature, threshold and, for the last level, value."""

    def __init__(self, base: float, feature=None, threshold=None, value=None, depth: int = 0):
        self.base, self.feature, self.threshold, self.value, self.depth = base, feature, threshold, value, depth

    def margin(self, x: np.ndarray) -> np.ndarray:
        if self.feature is None:
            return np.full(len(x), self.base)
        trees = np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            right = x[rows, self.feature[trees, node]] > self.threshold[trees, node]
            node = 2 * node + 1 + right
        return self.base + self.value[trees, node - (2 ** self.depth - 1)].sum(1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2,
              reg: float = 1.0, min_hess: float = 2.0) -> Trees:
    """Logistic boosting with histogram splits."""
    n1, n = float(y.sum()), len(y)
    p0 = (n1 + 1) / (n + 2)
    base = float(np.log(p0 / (1 - p0)))
    if not 0 < n1 < n:
        return Trees(base)
    m = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(m)], 1)  # bin b: x <= cuts[b]
    width = bins + 1
    cell = binned + np.arange(m) * width
    inner, leaves = 2 ** depth - 1, 2 ** depth
    out_f, out_t = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
    out_v, margin = np.zeros((trees, leaves)), np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, np.int64)                            # within the level
        for level in range(depth):
            k = 2 ** level
            flat = (node[:, None] * (m * width) + cell).ravel()
            hg = np.bincount(flat, np.repeat(g, m), k * m * width).reshape(k, m, width).cumsum(2)
            hh = np.bincount(flat, np.repeat(h, m), k * m * width).reshape(k, m, width).cumsum(2)
            sg, sh = hg[:, :1, -1:], hh[:, :1, -1:]
            gain = hg ** 2 / (hh + reg) + (sg - hg) ** 2 / (sh - hh + reg) - sg ** 2 / (sh + reg)
            gain[(hh < min_hess) | (sh - hh < min_hess)] = -np.inf
            best = gain.reshape(k, -1).argmax(1)
            f, b = best // width, best % width
            split = gain.reshape(k, -1)[np.arange(k), best] > 1e-6
            at = 2 ** level - 1 + np.arange(k)
            out_f[t, at] = f
            out_t[t, at] = [cuts[f[i]][b[i]] if split[i] and b[i] < len(cuts[f[i]]) else np.inf for i in range(k)]
            node = 2 * node + (x[np.arange(n), out_f[t, at][node]] > out_t[t, at][node])
        gl, hl = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
        out_v[t] = -rate * gl / (hl + reg)
        margin += out_v[t][node]
    return Trees(base, out_f, out_t, out_v, depth)


def _features(texts: pd.Series) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(len(texts), N_FEATURES)


def fit(docs: DataFrame, labels: DataFrame, keep, label: str = "quality", max_rows: int = MAX_TRAIN) -> Trees:
    """Fit on the statistics (computed on the executors) of at most ``max_rows`` labelled ids."""
    @F.pandas_udf("array<double>")
    def stats(texts: pd.Series) -> pd.Series:
        return pd.Series(list(_features(texts)))

    rows = labelled_sample(docs, labels, label, keep, max_rows).select("doc_id", stats("text").alias("x"), "y") \
        .orderBy("doc_id").collect()
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), N_FEATURES)
    return fit_trees(x, np.array([r["y"] for r in rows], float))


def scorer(model: Trees) -> Callable:
    """A column function text -> score."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.predict(_features(texts)))
    return score
