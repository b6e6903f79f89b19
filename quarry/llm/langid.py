"""Language ID of words and documents by a linear-chain conditional random field.

Words (runs of letters, lower-cased) are labelled in context, so code-switched
text gets a language per word; a document's language is the one with the
largest mean posterior over its words.

* Features of a word: hashed character trigrams of ``^word$`` (bytes), hashed
  prefix and suffix of four bytes, and membership in a lexicon of the words
  most frequent in the training sample.
* Transitions are learned on chains that splice segments of different
  documents, so that staying and switching both have evidence.
* Inference is exact forward-backward; a chain is a line, and a line of more
  than ``CHAIN`` words is several chains.  All chains of a chunk move in step.

Fitting uses at most ``MAX_PER_LANG`` documents of each language (chosen by
hash among those with a letter, whatever their length; of a text of more than
``MAX_TRAIN_CHARS`` characters, ``SEGMENTS`` segments at seeded places) and
minibatch Adagrad on the exact gradient.  Scoring reads the text only, whole, in chunks of ``CHUNK``
bytes, whatever a document's length.

Defined results: ``und`` with score 0 where the text is null or has no letter,
or where there was nothing to learn from; ties go to the first language by code
point; rows repeating an id are scored each on its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_PER_LANG, MAX_TRAIN_CHARS, SEGMENTS, LEXICON = 400, 20_000, 20, 2_000
CHAIN, CHUNK, TABLE = 128, 1 << 20, 1 << 16
EPOCHS, RATE = 3, 0.3
_LETTER = regex.compile(r"\p{L}")
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[97:123] = _IS_LETTER[128:] = True
_POWERS = np.cumprod(np.full(1 << 10, 0x9E3779B97F4A7C15, np.uint64))


class Words:
    """Words of a byte string: feature rows, whole-word hashes and chain starts."""

    def __init__(self, data: bytes):
        b = np.frombuffer(data, np.uint8)
        letter = _IS_LETTER[b]
        at = np.flatnonzero(letter)
        first = np.ones(at.size, bool)
        first[1:] = np.diff(at) > 1
        self.start = np.flatnonzero(first)                  # of each word, among the letters
        self.n = self.start.size
        self.at = at[self.start]                            # of each word, among the bytes
        if not self.n:
            return
        length = np.diff(np.append(self.start, at.size))
        end = self.start + length - 1
        c = b[at].astype(np.int64)
        p1 = np.empty_like(c)
        p1[1:], p1[0] = c[:-1], 1
        p1[self.start] = 1                                  # ^
        p2 = np.empty_like(c)
        p2[1:], p2[0] = p1[:-1], 0
        p2[self.start] = 0
        self.grams = ((p2 * 40503 + p1 * 9973 + c * 31) * 2654435761 >> 7) & (TABLE - 1)
        self.last = ((p1[end] * 40503 + c[end] * 9973 + 2 * 31) * 2654435761 >> 7) & (TABLE - 1)  # $
        pre, suf = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        for k in range(4):
            pre = pre * 257 + np.where(length > k, c[np.minimum(self.start + k, c.size - 1)], 0)
            suf = suf * 257 + np.where(length > k, c[np.maximum(end - k, 0)], 0)
        self.affix = [((pre * 2654435761 + 12345) >> 9) & (TABLE - 1), ((suf * 2654435761 + 98765) >> 9) & (TABLE - 1)]
        pos = np.arange(c.size) - np.repeat(self.start, length)
        self.hash = np.add.reduceat((c.astype(np.uint64) + np.uint64(1)) * _POWERS[pos & 1023], self.start)
        newline = np.flatnonzero(b == 10)
        line = np.searchsorted(newline, self.at)
        fresh = np.ones(self.n, bool)
        fresh[1:] = line[1:] != line[:-1]
        head = np.maximum.accumulate(np.where(fresh, np.arange(self.n), 0))
        self.fresh = fresh | ((np.arange(self.n) - head) % CHAIN == 0)

    def chains(self) -> tuple[np.ndarray, np.ndarray]:
        s = np.flatnonzero(self.fresh)
        return s, np.diff(np.append(s, self.n))


def forward_backward(emit: np.ndarray, trans: np.ndarray, begin: np.ndarray, starts: np.ndarray, lengths: np.ndarray,
                     pairs: bool = False):
    """Posteriors of every word, and the expected transition counts if asked for.  All chains take
    a step at a time, longest first, so that the active ones are a prefix."""
    order = np.argsort(-lengths, kind="stable")
    s, n = starts[order], lengths[order]
    active = np.searchsorted(-n, -np.arange(n[0] if n.size else 0), side="left")   # chains longer than t
    alpha, beta = np.empty_like(emit), np.ones_like(emit)
    for t, k in enumerate(active):
        i = s[:k] + t
        a = (begin if t == 0 else alpha[i - 1] @ trans) * emit[i]
        alpha[i] = a / a.sum(1, keepdims=True)
    counts = np.zeros_like(trans)
    for t in range(len(active) - 1, 0, -1):
        i = s[:active[t]] + t
        eb = emit[i] * beta[i]
        back = eb @ trans.T
        if pairs:
            z = (alpha[i - 1] * back).sum(1, keepdims=True)
            counts += alpha[i - 1].T @ (eb / z) * trans
        beta[i - 1] = back / back.sum(1, keepdims=True)
    post = alpha * beta
    return post / post.sum(1, keepdims=True), counts


class Crf:
    def __init__(self, langs: list[str], lexicon: np.ndarray):
        n = len(langs)
        self.langs, self.lexicon = langs, lexicon
        self.grams, self.affix = np.zeros((TABLE, n), np.float32), np.zeros((TABLE, n), np.float32)
        self.lex = np.zeros((len(lexicon) + 1, n), np.float32)      # the last row: not in the lexicon
        self.trans, self.begin = np.zeros((n, n)), np.zeros(n)

    def lookup(self, w: Words) -> np.ndarray:
        if not len(self.lexicon):
            return np.zeros(w.n, np.int64)
        i = np.minimum(np.searchsorted(self.lexicon, w.hash), len(self.lexicon) - 1)
        return np.where(self.lexicon[i] == w.hash, i, len(self.lexicon))

    def emissions(self, w: Words) -> np.ndarray:
        e = np.add.reduceat(self.grams[w.grams], w.start, axis=0) + self.grams[w.last]
        e += self.affix[w.affix[0]] + self.affix[w.affix[1]] + self.lex[self.lookup(w)]
        return np.exp((e - e.max(1, keepdims=True)).clip(-30).astype(np.float64))

    def posteriors(self, w: Words) -> np.ndarray:
        starts, lengths = w.chains()
        return forward_backward(self.emissions(w), np.exp(self.trans), np.exp(self.begin), starts, lengths)[0]

    def documents(self, texts) -> np.ndarray:
        """Sums of the word posteriors of whole texts, one row each; zero without a letter.  Texts
        share chunks of about CHUNK bytes (a line end apart), so that the steps of
        forward-backward serve many chains at once."""
        total = np.zeros((len(texts), len(self.langs)))
        parts, owner, size = [], [], 0

        def flush():
            w = Words(b"\n".join(parts))
            if w.n:
                ends = np.cumsum([len(x) + 1 for x in parts])
                who = np.asarray(owner)[np.searchsorted(ends, w.at, side="right")]
                post = self.posteriors(w)
                for k in range(total.shape[1]):
                    total[:, k] += np.bincount(who, post[:, k], len(total))

        for i, t in enumerate(texts):
            if not t or not _LETTER.search(t):
                continue
            for piece in pieces(t.lower().encode("utf-8", "surrogatepass")):
                parts.append(piece)
                owner.append(i)
                size += len(piece)
                if size >= CHUNK:
                    flush()
                    parts, owner, size = [], [], 0
        if parts:
            flush()
        return total


def pieces(data: bytes, size: int = CHUNK):
    """A long text in pieces that end at white space where there is any in reach."""
    at = 0
    while len(data) - at > size:
        cut = max(data.rfind(b"\n", at, at + size), data.rfind(b" ", at, at + size)) + 1
        cut = cut if cut > at else at + size
        yield data[at:cut]
        at = cut
    yield data[at:]


def train(texts: list[str], labels: list[str], seed: int = 5) -> Crf:
    langs = sorted(set(labels))
    code = {x: i for i, x in enumerate(langs)}
    n_langs, rng = len(langs), np.random.default_rng(seed)
    data = [(Words(t.lower().encode("utf-8", "surrogatepass")), code[y]) for t, y in zip(texts, labels)]
    data = [(w, y) for w, y in data if w.n]
    best = []
    for lang in range(n_langs):
        h = np.concatenate([w.hash for w, y in data if y == lang] or [np.zeros(0, np.uint64)])
        u, c = np.unique(h, return_counts=True)
        best.append(u[np.lexsort((u, -c))][:LEXICON])
    crf = Crf(langs, np.unique(np.concatenate(best)))
    sq = [np.full_like(p, 1e-6) for p in (crf.grams, crf.affix, crf.lex, crf.trans, crf.begin)]
    for _ in range(EPOCHS):
        order = rng.permutation(len(data))
        for lo in range(0, len(order), 64):
            _step(crf, [data[i] for i in order[lo:lo + 64]], sq, rng)
    return crf


def _step(crf: Crf, batch, sq, rng) -> None:
    """One Adagrad step on chains spliced from segments of the batch's documents."""
    n_langs = len(crf.langs)
    emit, gold, segs, base = [], [], [], 0
    for w, y in batch:
        emit.append(crf.emissions(w))
        gold.append(np.full(w.n, y))
        at = 0
        while at < w.n:
            k = min(w.n - at, int(rng.integers(4, 48)))
            segs.append((base + at, k))
            at += k
        base += w.n
    rng.shuffle(segs)
    perm = np.concatenate([np.arange(a, a + k) for a, k in segs])
    emit, gold = np.concatenate(emit)[perm], np.concatenate(gold)[perm]
    starts = np.arange(0, base, CHAIN)
    lengths = np.minimum(CHAIN, base - starts)
    post, counts = forward_backward(emit, np.exp(crf.trans), np.exp(crf.begin), starts, lengths, pairs=True)
    one = np.eye(n_langs)[gold]
    inner = np.ones(base, bool)
    inner[starts] = False
    seen = np.zeros_like(crf.trans)
    np.add.at(seen, (gold[np.flatnonzero(inner) - 1], gold[inner]), 1)
    diff = np.empty_like(post)
    diff[perm] = post - one                                    # back in document order
    g_grams, g_affix, g_lex = (np.zeros_like(p) for p in (crf.grams, crf.affix, crf.lex))
    at = 0
    for w, _ in batch:
        d = diff[at:at + w.n]
        at += w.n
        per_gram = np.repeat(d, np.diff(np.append(w.start, w.grams.size)), axis=0)
        lex = crf.lookup(w)
        for j in range(n_langs):
            g_grams[:, j] += np.bincount(w.grams, per_gram[:, j], TABLE) + np.bincount(w.last, d[:, j], TABLE)
            g_affix[:, j] += np.bincount(w.affix[0], d[:, j], TABLE) + np.bincount(w.affix[1], d[:, j], TABLE)
            g_lex[:, j] += np.bincount(lex, d[:, j], len(g_lex))
    grads = [g_grams / base, g_affix / base, g_lex / base, (counts - seen) / base, (post - one)[starts].sum(0) / base]
    for p, g, s in zip((crf.grams, crf.affix, crf.lex, crf.trans, crf.begin), grads, sq):
        s += g * g
        p -= RATE * g / np.sqrt(s)


def training_text(text: Column, doc_id: Column) -> Column:
    """A text of at most ``MAX_TRAIN_CHARS`` characters whole; of a longer one the segment from its first letter
    and one at a hashed place of each equal part, without words cut in two where white space is in reach."""
    size = MAX_TRAIN_CHARS // SEGMENTS - 1

    def segment(j: Column) -> Column:
        part = (F.length(text) - size) / (SEGMENTS - 1)
        at = F.floor((j + F.pmod(F.xxhash64(doc_id, j), F.lit(1000)) / 1000) * part).cast("int") + 1
        return F.regexp_replace(F.substr(text, at, F.lit(size)), r"^\S*\s|\s\S*$", "")

    first = F.regexp_replace(F.substr(text, F.regexp_instr(text, F.lit(r"\p{L}")), F.lit(size)), r"\s\S*$", "")
    rest = F.transform(F.sequence(F.lit(0), F.lit(SEGMENTS - 2)), segment)
    return F.when(F.length(text) <= MAX_TRAIN_CHARS, text).otherwise(F.array_join(F.concat(F.array(first), rest), "\n"))


def fit(docs: DataFrame, keep: Column, max_per_lang: int = MAX_PER_LANG) -> Crf | None:
    """Learn from a bounded sample of the rows that ``keep`` admits; None if there are none."""
    pool = docs.where(keep & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
                      & F.col("text").rlike(r"\p{L}"))
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = pool.select("doc_id", "lang").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max_per_lang)
    rows = pool.select("doc_id", "lang", training_text(F.col("text"), F.col("doc_id")).alias("text")).join(F.broadcast(ids.select("doc_id", "lang").distinct()), ["doc_id", "lang"]) \
        .groupBy("doc_id", "lang").agg(F.min("text").alias("text")).orderBy("lang", "doc_id").collect()
    rows = [r for r in rows if _LETTER.search(r["text"])]
    return train([r["text"] for r in rows], [r["lang"] for r in rows]) if rows else None


def scorer(crf: Crf | None):
    """A column function text -> struct(lang_pred, score)."""
    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def score(texts: pd.Series) -> pd.DataFrame:
        if crf is None:
            return pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": 0.0})
        total = crf.documents(list(texts))
        mass, top = total.sum(1), total.argmax(1)
        return pd.DataFrame({"lang_pred": np.where(mass > 0, np.array(crf.langs, object)[top], "und"),
                             "score": np.where(mass > 0, total.max(1) / np.where(mass > 0, mass, 1), 0.0)})
    return score
