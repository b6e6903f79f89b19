"""Hierarchical Pitman-Yor bigram model, sampled by Gibbs over Spark groups; log probabilities of whole texts.

Every context word u has a restaurant over next words w; all context restaurants share one parent, the
restaurant of all words, above a uniform base over the training vocabulary and one unknown word.  A context's
table is a customer of the parent:

    P(w)   = (K_w - d0 s_w) / (t0 + K) + (t0 + d0 S) / (t0 + K) / (V + 1)
    P(w|u) = (c_uw - d1 t_uw) / (t1 + c_u) + (t1 + d1 T_u) / (t1 + c_u) P(w)

with c customers, t and s tables, T, K and S their sums.  Discounts come from counts of counts, strengths are
parameters.

* Tokens are shuffled once, packed, to the group that holds their word's part of the hash space (words of more
  than a share of a sample of the tokens, and the end token, are spread over all groups by word and context), and
  stored there as dishes (u, w, c) and document references, one row per group, bucketed by group.
* A round makes ``sweeps`` sweeps (``gibbs``): every customer of every dish leaves and is seated again by the
  Chinese-restaurant probabilities (``Seating``), tables that close and open take their customers out of and into the
  parent's restaurant (``Parent``), whose customers then move too.  The next round goes on from these seatings;
  tables are averaged after a round's first sweep, and the last round's averages are used.  Customers move
  one at a time, but those of a word with more than ``STEPS`` in ``STEPS`` parts, in the parent's restaurant ``PARTS``.  Contexts spread over
  groups, so their numbers of tables T_u are exchanged between rounds (each group asks the owner of the context's range;
  there is one owner for every ``OWNED`` groups) and stay fixed within a round, as K and S do.
* Scores use the averaged seating, whose T, K and S are summed once more, so that P(.|u) sums to 1.  A token's
  probability splits into a factor of its context and one of (context, word), hence a group scores its tokens
  alone and sends one partial sum per document.

Everything grows with the corpus and stays in the groups; the driver sees the spread words only (fewer than
``4 * groups``) and a few sums.  Words are known by 64-bit fingerprints, contexts by 48 bits of them.

Defined results: null and empty texts are one token, the end; rows repeating an id are scored each; null ids stay
null and have the fold of the empty string; without a training row every score is that of the uniform base; an
empty table gives no row; further columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.batches import arrow_batches
from quarry.llm.blobs import deltas, narrow, pack, range_of, undelta, unpack
from quarry.llm.polyhash import Polynomial
from quarry.llm.shingles import _SPACE, mix
from quarry.session import cut_lineage, drop_lineage, drop_path, scratch_path

STRENGTH, ROUNDS, SWEEPS, MOVES, SEED = 1.0, 2, 3, 1, 11
STEPS, PARTS, FEW = 64, 12, 8
ONE = np.int32(1)
BLOCK, CHUNK_TOKENS, SAMPLE, OWNED = 1 << 20, 1_500_000, 64, 8
START, END = np.uint64(0x5354415254000000), np.uint64(0xE4D0000000000000)
_POLY = Polynomial(5)
_LOW = np.uint64(16)


# -- tokens -----------------------------------------------------------------------------------------------

def _blocks(texts: list[bytes]) -> Iterator[list[tuple[int, bytes]]]:
    """Runs of (text number, bytes) of about ``BLOCK`` bytes; long texts are cut at white space."""
    run, size = [], 0
    for i, data in enumerate(texts):
        at = 0
        while at < len(data):
            end = len(data)
            if end - at > BLOCK:
                cut = max(data.rfind(s, at, at + BLOCK) for s in (b" ", b"\n", b"\t")) + 1
                if cut <= at:
                    later = [x for x in (data.find(s, at + BLOCK) for s in (b" ", b"\n", b"\t")) if x >= 0]
                    cut = min(later) + 1 if later else end
                end = cut
            run.append((i, data[at:end]))
            size += end - at
            at = end
            if size >= BLOCK:
                yield run
                run, size = [], 0
    if run:
        yield run


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words of the texts, and the text of each."""
    hashes, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for run in _blocks([t.encode("utf-8", "surrogatepass").lower() for t in texts]):
        data = np.frombuffer(b" ".join(part for _, part in run), np.uint8)
        edge = np.flatnonzero(np.diff((~_SPACE[data]).view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        start, end = edge[::2], edge[1::2]
        if start.size:
            begin = np.cumsum([0] + [len(part) + 1 for _, part in run[:-1]])
            hashes.append(_POLY.words(data, start, end))
            owner.append(np.array([i for i, _ in run])[np.searchsorted(begin, start, "right") - 1])
    return np.concatenate(hashes), np.concatenate(owner)


def with_ends(words: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, their contexts and their texts: every text's words and one end."""
    counts = np.bincount(owner, minlength=n) + 1
    token = np.full(words.size + n, END, np.uint64)
    token[np.arange(words.size) + owner] = words
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[np.cumsum(counts) - counts] = START
    return token, context >> _LOW, np.repeat(np.arange(n), counts)


def frequent_words(docs: DataFrame, groups: int) -> np.ndarray:
    """Words to spread over the groups: more than 1 in ``4 * groups`` tokens of a sample of the texts (this places
    rows, it does not change counts), and always the end."""
    words = F.explode(F.expr(r"regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+', 0)"))
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select(words.alias("w")).groupBy("w").count()
    total = sample.agg(F.sum("count")).first()[0] or 0
    found = [r["w"] for r in sample.where(F.col("count") * 4 * groups > total).where("count >= 20").collect()]
    return np.unique(np.append(word_hashes(found)[0], END))


def _sender(groups: int, hot: np.ndarray, chunk_tokens: int):
    """Texts -> packed tokens per group, and per chunk a row with the documents' ids and numbers of tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, flushed = TaskContext.get().partitionId(), 0
        ids, train, words, owner, size = [], [], [], [], 0

        def flush() -> Iterator[pd.DataFrame]:
            nonlocal ids, train, words, owner, size, flushed
            if not ids:
                return
            token, context, doc = with_ends(np.concatenate(words), np.concatenate(owner), len(ids))
            chunk = part << 24 | flushed
            flushed += 1
            flags = np.array(train, bool)
            spot = np.minimum(np.searchsorted(hot, token), hot.size - 1)
            is_hot = hot[spot] == token
            key = np.where(is_hot, mix(token ^ (context << _LOW)), token)
            order = np.argsort(key)
            key = key[order]
            group = range_of(key, groups)
            del key
            edge = np.append(np.flatnonzero(np.diff(group, prepend=np.uint64(groups + 1))), group.size)
            rows = [(-1 - chunk % groups, chunk, pack(narrow(np.bincount(doc, minlength=len(ids))), flags.view(np.uint8)), ids)]
            for a, z in zip(edge[:-1], edge[1:]):
                at = order[a:z]
                at = np.concatenate([at[~is_hot[at]], at[is_hot[at]]])
                n_hot = int(is_hot[at].sum())
                cold = token[at[:at.size - n_hot]]
                new = np.flatnonzero(np.diff(cold, prepend=cold[:1] ^ np.uint64(1))) if cold.size else np.zeros(0, np.int64)
                us, u_at = np.unique(context[at], return_inverse=True)
                docs_here, d_at = np.unique(doc[at], return_inverse=True)
                rows.append((int(group[a]), chunk, pack(
                    deltas(cold[new]), narrow(np.diff(np.append(new, cold.size))), narrow(spot[at[at.size - n_hot:]]),
                    deltas(us), narrow(u_at), narrow(deltas(docs_here)), narrow(d_at), flags[docs_here].view(np.uint8)), None))
            ids, train, words, owner, size = [], [], [], [], 0
            yield pd.DataFrame(rows, columns=["g", "chunk", "blob", "ids"])

        for pdf in batches:
            w, o = word_hashes(list(pdf["text"]))
            words.append(w)
            owner.append(o + len(ids))
            ids.extend(pdf["id"])
            train.extend(pdf["train"])
            size += w.size + len(pdf)
            if size >= chunk_tokens:
                yield from flush()
        yield from flush()

    return run


# -- the corpus, one row per group --------------------------------------------------------------------------

STORED = ("g int, chunk long, ids array<string>, meta binary, dishes binary, tokens binary, "
          "asks array<struct<h: int, blob: binary>>, hot array<struct<i: int, c: long, k: double, t: double>>, "
          "n long, v long, k long, n1 long, n2 long, m1 long, m2 long")


def _asks(us: np.ndarray, tables: np.ndarray, groups: int) -> list[dict]:
    """Tables per context, addressed to the owners of the contexts (each owns the ranges of ``OWNED`` groups)."""
    home = range_of(us << _LOW, groups) // np.uint64(OWNED)
    edge = np.append(np.flatnonzero(np.diff(home, prepend=np.uint64(groups + 1))), home.size)
    return [{"h": int(home[a]), "blob": pack(deltas(us[a:z]), tables[a:z].astype(np.float32))} for a, z in zip(edge[:-1], edge[1:])]


def _hot_sums(hot: np.ndarray, words: np.ndarray, c_w: np.ndarray, k_w: np.ndarray, us: np.ndarray, t_u: np.ndarray) -> list[dict]:
    """This group's part of the spread words' customers, of their dishes' tables, and of their restaurants' tables."""
    c, k, t = np.zeros(hot.size + 1), np.zeros(hot.size + 1), np.zeros(hot.size + 1)
    at = np.minimum(np.searchsorted(hot, words), hot.size - 1)
    hit = hot[at] == words
    c[at[hit]], k[at[hit]] = c_w[hit], k_w[hit]
    contexts = np.append(hot >> _LOW, START >> _LOW)
    place = np.argsort(contexts)
    at = place[np.minimum(np.searchsorted(contexts, us, sorter=place), contexts.size - 1)]
    hit = contexts[at] == us
    np.add.at(t, at[hit], t_u[hit])
    some = np.flatnonzero((c > 0) | (k > 0) | (t > 0))
    return [{"i": int(i), "c": int(c[i]), "k": float(k[i]), "t": float(t[i])} for i in some]


def _store(groups: int, hot: np.ndarray):
    """Packed tokens of one group -> its row of dishes, token references and first table counts."""
    columns = "g chunk ids meta dishes tokens asks hot n v k n1 n2 m1 m2".split()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        g = int(pdf["g"].iloc[0])
        if g < 0:
            return pd.DataFrame([(g, int(i), ids, meta) + (None,) * (len(columns) - 4)
                                 for i, ids, meta in zip(pdf["chunk"], pdf["ids"], pdf["blob"])], columns=columns, dtype=object)
        pdf = pdf.sort_values("chunk")
        chunks, blobs, parts = pdf["chunk"].to_numpy(np.int64), list(pdf["blob"]), []
        del pdf
        for j in range(len(blobs)):
            blob, blobs[j] = blobs[j], None
            step, times, hots, us, u_at, docs, d_at, flags = unpack(blob)
            w = np.concatenate([np.repeat(undelta(step), times), hot[hots]])
            docs = undelta(docs.astype(np.int64))
            parts.append((w, undelta(us)[u_at], np.full(w.size, j, np.int32), docs[d_at].astype(np.int32), flags[d_at]))
        w, u, chunk, doc, train = [np.concatenate(x) for x in zip(*parts)]
        parts.clear()
        words, pair = np.unique(w, return_inverse=True)
        del w
        us, u_at = np.unique(u, return_inverse=True)
        del u
        pair = pair.astype(np.int64, copy=False) << 32
        pair |= u_at
        del u_at
        order = np.argsort(pair)
        pair, chunk, doc, train = pair[order], chunk[order], doc[order], train[order]
        at = np.flatnonzero(np.diff(pair, prepend=-1))
        times = np.diff(np.append(at, train.size))
        c = np.add.reduceat(train, at, dtype=np.int64)
        pair = pair[at]
        del order, train
        pair_w, pair_u = pair >> 32, pair & 0xFFFFFFFF
        seen = c > 0
        used, dish_u = np.unique(pair_u[seen], return_inverse=True)
        dish_w, us = pair_w[seen], us[used]
        c_w = np.bincount(dish_w, c[seen], words.size).astype(np.int64)
        k_w = np.bincount(dish_w, minlength=words.size)
        t_u = np.bincount(dish_u, minlength=us.size)
        of_seen = np.repeat(seen, times)
        cold = ~np.isin(words, hot)
        row = {
            "g": g, "chunk": None, "ids": None, "meta": None,
            "dishes": pack(deltas(words), narrow(k_w), narrow(c[seen]), deltas(us), narrow(dish_u)),
            "tokens": pack(chunks, narrow(times[seen]), narrow(chunk[of_seen]), narrow(doc[of_seen]),
                           narrow(np.bincount(pair_w[~seen], times[~seen], words.size).astype(np.int64)),
                           narrow(chunk[~of_seen]), narrow(doc[~of_seen])),
            "asks": _asks(us, t_u, groups), "hot": _hot_sums(hot, words, c_w, k_w, us, t_u),
            "n": int(c.sum()), "v": int((c_w[cold] > 0).sum()), "k": int(seen.sum()),
            "n1": int((c == 1).sum()), "n2": int((c == 2).sum()),
            "m1": int((k_w[cold] == 1).sum()), "m2": int((k_w[cold] == 2).sum())}
        return pd.DataFrame([row], columns=columns, dtype=object)

    return merge


def _answer(groups: int):
    """All asks about one range of contexts -> the summed tables, back to each asker in its order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(b) for b in pdf["blob"]]
        us = [undelta(p[0]) for p in parts]
        known, at = np.unique(np.concatenate(us), return_inverse=True)
        total = np.bincount(at, np.concatenate([p[1] for p in parts]).astype(np.float64))
        h, rows, begin = int(pdf["h"].iloc[0]), [], 0
        for g, u in zip(pdf["g"], us):
            rows.append((int(g), "tables", h, pack(total[at[begin:begin + u.size]].astype(np.float32))))
            begin += u.size
        mine = range_of(known << _LOW, groups)
        edge = np.append(np.flatnonzero(np.diff(mine, prepend=np.uint64(groups + 1))), mine.size)
        rows += [(int(mine[a]), "own", h, pack(deltas(known[a:z]), total[a:z].astype(np.float32))) for a, z in zip(edge[:-1], edge[1:])]
        return pd.DataFrame(rows, columns=["g", "kind", "h", "blob"])

    return run


# -- seating ------------------------------------------------------------------------------------------------

def _random_start(c: np.ndarray, new: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of tables and their sizes, dish after dish, to start the sampler from (any seating would do)."""
    t = np.minimum(1 + rng.poisson(new * np.log1p((c - 1) / new)), c).astype(np.int64)
    if not t.size:
        return t, t
    at = np.cumsum(t) - t
    share = rng.exponential(size=int(t.sum()))
    share /= np.repeat(np.add.reduceat(share, at), t)
    size = 1 + np.floor(share * np.repeat(c - t, t)).astype(np.int64)
    size[at] += c - np.add.reduceat(size, at)
    return t, size


class Seating:
    """Tables of dishes with ``c >= 1`` customers each, every customer with its table; customers move by Gibbs steps.

    ``new`` is a dish's weight for a new table, (strength + discount * tables of the restaurant) * P(dish).  A pass
    (``turns``) takes every customer once, in at most ``steps`` steps: a step takes one customer of every label (a word,
    whose dishes share a place in the parent's restaurant), and of a label with more than ``steps`` customers every
    ``steps``-th; those that move together do not see each other's new seats."""

    def __init__(self, c: np.ndarray, new: np.ndarray | None, discount: float, steps: int, rng: np.random.Generator,
                 start: tuple[np.ndarray, np.ndarray] | None = None):
        self.c, self.d, self.steps, self.rng = c.astype(np.int64), discount, steps, rng
        t, sizes = _random_start(self.c, new, rng) if start is None else start
        self.t = t.astype(np.int64)
        self.off = np.cumsum(self.c) - self.c
        n = int(self.c.sum())
        slot = np.arange(n) - np.repeat(self.off, self.c)
        self.size = np.zeros(n, np.int32)
        tables = np.flatnonzero(slot < np.repeat(self.t, self.c))
        self.size[tables] = sizes
        self.free = np.arange(n, dtype=np.int32 if n < 1 << 31 else np.int64)       # a dish's free tables lie from its t-th place on
        self.seat = np.repeat(tables, sizes).astype(self.free.dtype)

    def sizes(self) -> np.ndarray:
        """Sizes of the occupied tables, dish after dish."""
        return self.size[self.size > 0]

    def turns(self, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(customers, their dishes) of the steps of a pass; dishes of a label lie together."""
        dish = np.repeat(np.arange(self.c.size, dtype=np.int32), self.c)
        begin = self.off[np.flatnonzero(np.diff(label, prepend=label[:1] - 1))]
        step = (np.arange(dish.size) - np.repeat(begin, np.diff(np.append(begin, dish.size)))) % self.steps
        order = np.argsort(step.astype(np.int16 if self.steps < 1 << 15 else np.int64), kind="stable")
        edge = np.append(0, np.cumsum(np.bincount(step)))
        del step
        for a, z in zip(edge[:-1], edge[1:]):
            yield order[a:z], dish[order[a:z]]

    def leave(self, at: np.ndarray, dish: np.ndarray) -> np.ndarray:
        """The customers stand up; returns the dishes of the tables that closed."""
        left = self.seat[at].astype(np.intp)
        np.subtract.at(self.size, left, ONE)                                 # equal types: numpy's fast loop
        self.seat[at] = -1
        shut = np.flatnonzero(self.size[left] == 0)
        if not shut.size:
            return shut
        table, first = np.unique(left[shut], return_index=True)              # tables lie dish after dish
        of = dish[shut[first]]
        which, begin, count = np.unique(of, return_index=True, return_counts=True)
        self.t[which] -= count
        self.free[np.repeat(self.off[which] + self.t[which] - begin, count) + np.arange(of.size)] = table
        return of

    def join(self, at: np.ndarray, dish: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Standing customers sit down, ``new`` the weight of a new table for each; returns the dishes of the new tables."""
        up = np.bincount(dish, minlength=self.c.size)[dish] if at.size and self.c[dish].max() > self.steps else 1
        seated = self.c[dish] - up - self.d * self.t[dish]
        opens = self.rng.random(at.size) * (seated + new) < new
        opens |= self.t[dish] == 0
        wait, sat = np.flatnonzero(~opens), np.empty(at.size, self.seat.dtype)
        begin, span = self.off[dish], self.c[dish]
        for tries in range(99):     # a random seated customer's table, taken with 1 - d / size, is one by weight size - d
            if not wait.size or tries > 1 and span[wait].sum() < 1 << 20:
                break
            pick = self.seat[begin[wait] + (self.rng.random(wait.size) * span[wait]).astype(np.int64)]
            took = (pick >= 0) & (self.rng.random(wait.size) * self.size[pick] >= self.d)
            sat[wait[took]] = pick[took]
            wait = wait[~took]
        if wait.size:               # the rest choose from all seated customers, by the weight 1 - d / size
            count = span[wait]
            end = np.cumsum(count)
            pick = self.seat[np.arange(end[-1]) + np.repeat(begin[wait] - end + count, count)]
            weight = np.where(pick >= 0, 1 - self.d / np.maximum(self.size[pick], 1), 0.0)
            upto = np.cumsum(weight)
            low = np.append(0.0, upto[end[:-1] - 1])
            one = np.searchsorted(upto, low + self.rng.random(wait.size) * (upto[end - 1] - low), "right")
            one = np.clip(one, end - count, end - 1)
            for j in np.flatnonzero(weight[one] <= 0):             # rounding at the edge of a customer
                one[j] = end[j] - count[j] + weight[end[j] - count[j]:end[j]].argmax()
            sat[wait] = pick[one]
        put = np.flatnonzero(opens)
        of = dish[put]
        if put.size:
            by = np.argsort(of, kind="stable")
            which, begin, count = np.unique(of[by], return_index=True, return_counts=True)
            sat[put[by]] = self.free[np.repeat(self.off[which] + self.t[which] - begin, count) + np.arange(of.size)]
            self.t[which] += count
        self.seat[at] = sat
        np.add.at(self.size, sat.astype(np.intp), ONE)
        return of

    def move(self, new: np.ndarray) -> None:
        """One random customer of every dish leaves and is seated again."""
        dish = np.arange(self.c.size)
        at = self.off + (self.rng.random(self.c.size) * self.c).astype(np.int64)
        self.leave(at, dish)
        self.join(at, dish, new)


class Parent:
    """Tables of the parent's restaurant: a row of sizes per word.  Its customers, the tables of the contexts, come and
    go; those that come at once take the urn's places in turn, except that they do not see each other's new tables."""

    def __init__(self, customers: np.ndarray, base: float, discount: float, rng: np.random.Generator,
                 start: tuple[np.ndarray, np.ndarray] | None = None):
        self.k, self.base, self.d, self.rng = customers.astype(np.int64), base, discount, rng
        some = np.flatnonzero(self.k > 0)
        t, sizes = start if start is not None else _random_start(self.k[some], np.full(some.size, base), rng)
        self.s = np.zeros(self.k.size, np.int64)
        self.s[some] = t
        self.upto = np.maximum(self.s, 1)                       # no table of the word lies at this place or after it
        self.size = np.zeros((self.k.size, max(4, int(self.s.max(initial=0)) + 2)), np.int64)
        self.size[np.repeat(some, t), np.arange(sizes.size) - np.repeat(np.cumsum(t) - t, t)] = sizes

    def width(self, w: np.ndarray) -> int:
        return int(self.upto[w].max(initial=1))

    def _pick(self, rows: np.ndarray, weight: np.ndarray) -> np.ndarray:
        upto = np.cumsum(weight, 1)
        at = (upto <= (self.rng.random(len(rows)) * upto[:, -1])[:, None]).sum(1)
        odd = np.flatnonzero(np.minimum(at, rows.shape[1] - 1) != at)        # rounding at the edge of the last table
        at[odd] = weight[odd].argmax(1)
        return at

    def leave(self, w: np.ndarray, m: np.ndarray) -> None:
        """``m`` random customers of each of the words ``w`` (all different) leave."""
        if m.max(initial=0) > FEW:
            self._leave_many(w[m > FEW], m[m > FEW])
            w, m = w[m <= FEW], m[m <= FEW]
        while w.size:
            rows = self.size[w, :self.width(w)]
            at = self._pick(rows, rows)
            self.size[w, at] -= 1
            self.s[w] -= rows[np.arange(w.size), at] == 1
            self.k[w] -= 1
            w, m = w[m > 1], m[m > 1] - 1

    def _leave_many(self, w: np.ndarray, m: np.ndarray) -> None:
        rows, rest, left = self.size[w, :self.width(w)], self.k[w].copy(), m.copy()
        for j in range(rows.shape[1]):
            if not left.any():
                break
            rest -= rows[:, j]
            gone = self.rng.hypergeometric(rows[:, j], rest, left)
            rows[:, j] -= gone
            left = left - gone
        self.size[w, :rows.shape[1]] = rows
        self.s[w] = (rows > 0).sum(1)
        self.k[w] -= m

    def join(self, w: np.ndarray, m: np.ndarray) -> None:
        """``m`` customers of each of the words ``w`` (all different) sit down."""
        if m.max(initial=0) > FEW:
            self._join_many(w[m > FEW], m[m > FEW])
            w, m = w[m <= FEW], m[m <= FEW]
        while w.size:
            seated = self.k[w] - self.d * self.s[w]
            opens = (self.rng.random(w.size) * (seated + self.base) < self.base) | (self.k[w] == 0)
            old = w[~opens]
            rows = self.size[old, :self.width(old)]
            self.size[old, self._pick(rows, np.where(rows > 0, rows - self.d, 0.0))] += 1
            self._open(w[opens], np.ones(int(opens.sum()), np.int64))
            self.k[w] += 1
            w, m = w[m > 1], m[m > 1] - 1

    def _join_many(self, w: np.ndarray, m: np.ndarray) -> None:
        first = self.k[w] == 0
        if first.any():
            self._open(w[first], np.ones(int(first.sum()), np.int64))
            self.k[w[first]] += 1
            m = m - first
        seated = self.k[w] - self.d * self.s[w]
        opens = self.rng.binomial(m, self.base / (seated + self.base))
        rows, left, weight = self.size[w, :self.width(w)], m - opens, seated
        final = rows.shape[1] - 1 - (rows[:, ::-1] > 0).argmax(1)
        for j in range(rows.shape[1]):
            if not left.any():
                break
            mine = np.where(rows[:, j] > 0, rows[:, j] - self.d, 0.0)
            weight = np.maximum(weight - mine, 0.0)
            share = np.where(final <= j, 1.0, self.rng.beta(np.maximum(mine, 1e-9), np.maximum(weight, 1e-9)))
            add = self.rng.binomial(left, np.where(mine > 0, share, 0.0))
            rows[:, j] += add
            left = left - add
        self.size[w, :rows.shape[1]] = rows
        self.k[w] += m
        self._open(w[opens > 0], opens[opens > 0])

    def _open(self, w: np.ndarray, m: np.ndarray) -> None:
        while w.size:
            if self.s[w].max() == self.size.shape[1]:
                self.size = np.concatenate([self.size, np.zeros_like(self.size)], 1)
            at = (self.size[w] == 0).argmax(1)
            self.size[w, at] = 1
            self.upto[w] = np.maximum(self.upto[w], at + 1)
            self.s[w] += 1
            w, m = w[m > 1], m[m > 1] - 1

    def turn(self, steps: int) -> None:
        """As many random customers of every word as it has leave and sit down again, in at most ``steps`` parts."""
        total = self.k.copy()
        order = np.argsort(-total, kind="stable")
        by = total[order]
        for i in range(min(steps, int(total.max(initial=0)))):
            w = order[:np.searchsorted(-by, -i, "left")]
            m = np.where(total[w] > steps, total[w] * (i + 1) // steps - total[w] * i // steps, 1)
            wide = self.upto[w] > 4
            for part in (wide, ~wide):
                self.leave(w[part], m[part])
                self.join(w[part], m[part])

    def follow(self, customers: np.ndarray) -> None:
        """Customers come or go until each word has the given number."""
        change = customers.astype(np.int64) - self.k
        less, more = np.flatnonzero(change < 0), np.flatnonzero(change > 0)
        self.leave(less, -change[less])
        self.join(more, change[more])

    def state(self) -> tuple[np.ndarray, np.ndarray]:
        return self.s[self.k > 0], self.size[self.size > 0]


class Totals:
    """What the groups share in a round: sums, discounts and the spread words' counts."""

    def __init__(self, n: int, v: int, k: float, s: float, d0: float, d1: float, strength: float,
                 hot_c: np.ndarray, hot_k: np.ndarray, hot_s: np.ndarray, hot_t: np.ndarray):
        self.n, self.v, self.k, self.s, self.d0, self.d1, self.strength = n, v, k, s, d0, d1, strength
        self.hot_c, self.hot_k, self.hot_s, self.hot_t = hot_c, hot_k, hot_s, hot_t

    def parent(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return (np.maximum(customers - self.d0 * tables, 0.0) + self.base()) / (self.strength + self.k)

    def base(self) -> float:
        return (self.strength + self.d0 * self.s) / (self.v + 1)


def _tables_of(us: np.ndarray, replies: pd.DataFrame, hot: np.ndarray, totals: Totals) -> np.ndarray:
    """T_u of this group's contexts, from the owners' answers and the spread words."""
    got = replies[replies["kind"] == "tables"].sort_values("h")
    out = np.concatenate([np.zeros(0)] + [unpack(b)[0].astype(np.float64) for b in got["blob"]])
    contexts = np.append(hot >> _LOW, START >> _LOW)
    place = np.argsort(contexts)
    at = place[np.minimum(np.searchsorted(contexts, us, sorter=place), contexts.size - 1)]
    return np.where(contexts[at] == us, totals.hot_t[at], out)


def gibbs(c: np.ndarray, dish_w: np.ndarray, tables_u: np.ndarray, k0: np.ndarray, fixed: np.ndarray, s_fixed: np.ndarray,
          totals: Totals, sweeps: int, moves: int, rng: np.random.Generator,
          start: list[np.ndarray] | None = None) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """``sweeps`` sweeps over a group's restaurants, from the state ``start`` or a random one.  In a sweep every customer
    of every dish leaves and is seated again; a table that closes takes its customer out of the parent's restaurant, one
    that opens sends a customer there; then the parent's customers move, ``moves`` times as many as there are.  Words
    with ``fixed`` >= 0 have that many customers and ``s_fixed`` tables in the parent's restaurant all the time.

    Returns the averages (tables per dish; per word customers and tables of the parent's restaurant), the last tables per
    dish, and the last state."""
    many = np.flatnonzero(c > 1)
    rest = np.bincount(dish_w, minlength=k0.size) - np.bincount(dish_w[many], minlength=k0.size)
    word, strength = dish_w[many], (totals.strength + totals.d1 * tables_u)[many]
    cold, seen = fixed < 0, k0 > 0
    customers, tables = np.where(cold, k0, fixed).astype(np.float64), np.where(cold, 1.0 * seen, s_fixed)
    seats = Seating(c[many], strength * totals.parent(customers, tables)[word], totals.d1, STEPS, rng, start and tuple(start[:2]))
    above = Parent(np.where(cold, rest + np.bincount(word, seats.t, k0.size), 0), totals.base(), totals.d0, rng, start and tuple(start[2:]))
    sums, kept = [np.zeros(many.size), np.zeros(k0.size), np.zeros(k0.size)], 0

    def tell(change, dishes: np.ndarray) -> None:
        if dishes.size:
            w, m = np.unique(word[dishes], return_counts=True)
            mine = cold[w]
            w, m = w[mine], m[mine]
            change(w, m)
            customers[w], tables[w] = above.k[w], above.s[w]

    customers[cold], tables[cold] = above.k[cold], above.s[cold]
    for sweep in range(sweeps):
        for at, dish in seats.turns(word):
            tell(above.leave, seats.leave(at, dish))
            w = word[dish]
            tell(above.join, seats.join(at, dish, strength[dish] * totals.parent(customers[w], tables[w])))
        for _ in range(moves):
            above.turn(PARTS)
        tables[cold] = above.s[cold]
        if sweep or sweeps == 1:
            kept += 1
            for total, x in zip(sums, (seats.t, customers, tables)):
                total += x
    t, now = np.ones(c.size), np.ones(c.size)
    t[many], now[many] = sums[0] / kept, seats.t
    return [t, sums[1] / kept, sums[2] / kept], now, [seats.t, seats.sizes(), *above.state()]


def sample(c: np.ndarray, dish_w: np.ndarray, tables_u: np.ndarray, k0: np.ndarray, fixed: np.ndarray, s_fixed: np.ndarray,
           totals: Totals, sweeps: int, moves: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Averaged tables per dish, and per word averaged customers and tables of the parent's restaurant (``gibbs``)."""
    (t, customers, above), _, _ = gibbs(c, dish_w, tables_u, k0, fixed, s_fixed, totals, sweeps, moves, rng)
    return t, customers, above


PASSED = ("g int, kind string, h int, blob binary, hot array<struct<i: int, c: long, k: double, t: double>>, k double, s double, "
          "asks array<struct<h: int, blob: binary>>")


def _sampler(groups: int, hot: np.ndarray, totals: Totals, sweeps: int, moves: int, seed: int, last: bool):
    """A round of one group: its state passes to the next round, after the last one its averages to the scores."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["g", "kind", "h", "blob", "hot", "k", "s", "asks"]
        if left.empty:
            return pd.DataFrame(columns=columns)
        g = int(left["g"].iloc[0])
        words, k_w, c, us, dish_u = unpack(left["dishes"].iloc[0])
        words, us, k0 = undelta(words), undelta(us), k_w.astype(np.int64)
        dish_w = np.repeat(np.arange(words.size), k0)
        spot = np.minimum(np.searchsorted(hot, words), hot.size - 1)
        is_hot = hot[spot] == words
        fixed, s_fixed = np.where(is_hot, totals.hot_k[spot], -1.0), np.where(is_hot, totals.hot_s[spot], 0.0)
        tables = _tables_of(us, right, hot, totals)
        before = right[right["kind"] == "state"]
        start = [x.astype(np.int64) for x in unpack(before["blob"].iloc[0])] if len(before) else None
        (t, customers, above), now, state = gibbs(c.astype(np.int64), dish_w, tables[dish_u], k0, fixed, s_fixed, totals, sweeps,
                                                  moves, np.random.default_rng([seed, g]), start)
        if last:
            blob = pack(t[c > 1].astype(np.float32), np.where(is_hot, 0, customers).astype(np.float32), np.where(is_hot, 0, above).astype(np.float32))
            k, s = float(customers[~is_hot].sum()), float(above[~is_hot].sum())
        else:
            blob, t = pack(*[narrow(x) for x in state]), now
            k, s = float(np.bincount(dish_w, now, words.size)[~is_hot].sum()), float(state[2].sum())
        own_k = np.bincount(dish_w, t, words.size)
        t_u = np.bincount(dish_u, t, us.size)
        return pd.DataFrame([(g, "state", 0, blob, _hot_sums(hot, words, np.zeros(words.size), own_k, us, t_u), k, s,
                              _asks(us, t_u, groups))], columns=columns)

    return run


def _scorer(hot: np.ndarray, totals: Totals):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame(columns=["chunk", "blob", "ids"])
        words, k_w, c, us, dish_u = unpack(left["dishes"].iloc[0])
        words, us, k0, c = undelta(words), undelta(us), k_w.astype(np.int64), c.astype(np.int64)
        dish_w = np.repeat(np.arange(words.size), k0)
        spot = np.minimum(np.searchsorted(hot, words), hot.size - 1)
        is_hot = hot[spot] == words
        t, customers, above = np.ones(c.size), np.zeros(words.size), np.zeros(words.size)
        state = right[right["kind"] == "state"]
        if len(state):
            many, customers, above = [x.astype(np.float64) for x in unpack(state["blob"].iloc[0])]
            t[c > 1] = many
        customers, above = np.where(is_hot, totals.hot_k[spot], customers), np.where(is_hot, totals.hot_s[spot], above)
        p = totals.parent(customers, above)
        tables = _tables_of(us, right, hot, totals)
        own = np.zeros(words.size)
        for blob in right.loc[right["kind"] == "own", "blob"]:
            known, value = unpack(blob)
            known = undelta(known)
            at = np.minimum(np.searchsorted(known, words >> _LOW), known.size - 1)
            own = np.where(known[at] == words >> _LOW, value[at].astype(np.float64), 0.0)
        own = np.where(is_hot, totals.hot_t[spot], own)
        c_w = np.where(is_hot, totals.hot_c[spot], np.bincount(dish_w, c, words.size))
        factor = np.where((c_w > 0) & (words != END), np.log10((totals.strength + totals.d1 * own) / (totals.strength + c_w)), 0.0)
        gain = (c - totals.d1 * t) / (totals.strength + totals.d1 * tables[dish_u])
        chunks, times, chunk, doc, unseen, chunk_n, doc_n = unpack(left["tokens"].iloc[0])
        word = np.concatenate([np.repeat(dish_w, times), np.repeat(np.arange(words.size), unseen)])
        score = np.concatenate([np.repeat(np.log10(p[dish_w] + gain), times), np.repeat(np.log10(p), unseen)]) + factor[word]
        chunk, doc = np.concatenate([chunk, chunk_n]).astype(np.int64), np.concatenate([doc, doc_n]).astype(np.int64)
        known, base = c_w[word] > 0, np.log10(c_w + 1.0)[word]
        width = int(doc.max()) + 1
        keys, at = np.unique(chunk * width + doc, return_inverse=True)
        sums = [np.bincount(at, x, keys.size) for x in (known, base, score)]
        edge = np.append(np.flatnonzero(np.diff(keys // width, prepend=-1)), keys.size)
        rows = [(int(chunks[keys[a] // width]), pack(narrow(deltas(keys[a:z] % width)), narrow(sums[0][a:z].astype(np.int64)),
                                                    sums[1][a:z], sums[2][a:z]), None) for a, z in zip(edge[:-1], edge[1:])]
        return pd.DataFrame(rows, columns=["chunk", "blob", "ids"])

    return run


def _documents(totals: Totals, start: float):
    """A chunk's ids and all partial sums -> its documents."""
    floor = np.log10(totals.n + totals.v + 1.0)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        meta = pdf[pdf["ids"].notna()].iloc[0]
        tokens, train = unpack(meta["blob"])
        sums = np.zeros((3, tokens.size))
        for blob in pdf.loc[pdf["ids"].isna(), "blob"]:
            step, *parts = unpack(blob)
            at = undelta(step.astype(np.int64))
            for total, x in zip(sums, parts):
                total[at] += x
        return pd.DataFrame({"id": list(meta["ids"]), "held_out": train == 0, "n_tokens": tokens.astype(np.int64),
                             "n_known": sums[0].astype(np.int64), "base_score": sums[1] - tokens * floor, "score": sums[2] + start})

    return run


def _discount(n1: float, n2: float) -> float:
    return float(np.clip(n1 / (n1 + 2 * n2), 0.1, 0.95)) if n1 > 0 and n2 > 0 else 0.5


def score_texts(docs: DataFrame, keep: Column, id_col: str = "doc_id", text_col: str = "text", strength: float = STRENGTH,
                rounds: int = ROUNDS, sweeps: int = SWEEPS, moves: int = MOVES, seed: int = SEED,
                chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row; ``keep`` marks the rows to
    learn from.  Written to the shared folder."""
    spark = docs.sparkSession
    groups = OWNED * -(-2 * max(16, int(spark.conf.get("spark.sql.shuffle.partitions"))) // OWNED)
    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                        F.coalesce(keep, F.lit(False)).alias("train"))
    hot = frequent_words(texts, groups)
    name, path = f"quarry_hpy_{uuid.uuid4().hex}", scratch_path(spark, "hpy")
    with arrow_batches(spark, 500):
        sent = texts.mapInPandas(_sender(groups, hot, chunk_tokens), "g int, chunk long, blob binary, ids array<string>")
        sent.groupBy("g").applyInPandas(_store(groups, hot), STORED) \
            .write.bucketBy(groups, "g").option("path", path).saveAsTable(name)
    corpus = spark.table(name)

    def hot_sums(df: DataFrame) -> np.ndarray:
        """(customers, dish tables, restaurant tables) of the spread words, and the start's tables last."""
        out = np.zeros((3, hot.size + 1))
        for r in df.select(F.explode("hot").alias("x")).groupBy("x.i").agg(F.sum("x.c").alias("c"), F.sum("x.k").alias("k"), F.sum("x.t").alias("t")).collect():
            out[:, r["i"]] = r["c"], r["k"], r["t"]
        return out

    sums = corpus.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "k", "n1", "n2", "m1", "m2")]).first()
    start_docs = 0
    hot_c, hot_k, hot_t = hot_sums(corpus)
    start_docs = hot_c[np.searchsorted(hot, END)]             # every training text has one end, and one start
    d0, d1 = _discount(sums["m1"], sums["m2"]), _discount(sums["n1"], sums["n2"])
    vocabulary = int(sums["v"] + (hot_c[:-1] > 0).sum())
    rng = np.random.default_rng(seed)
    spread: Parent | None = None

    def totals(k_cold: float, s_cold: float) -> Totals:
        """Spread words' customers in the parent's restaurant come, go and move here, by their sums over the groups."""
        nonlocal spread
        live = hot_k[:-1] > 0
        customers = np.where(live, np.maximum(np.rint(hot_k[:-1]), 1), 0)
        base = (strength + d0 * (s_cold + (live.sum() if spread is None else spread.s.sum()))) / (vocabulary + 1)
        if spread is None:
            spread = Parent(customers, base, d0, rng)
        spread.base = base
        spread.follow(customers)
        for _ in range(moves):
            spread.turn(PARTS)
        hot_s = spread.s.astype(np.float64)
        return Totals(int(sums["n"]), vocabulary, k_cold + hot_k[:-1].sum(), s_cold + hot_s.sum(), d0, d1, strength,
                      hot_c[:-1], hot_k[:-1], hot_s, hot_t)

    now = totals(float(sums["k"] - hot_k[:-1].sum()), float(sums["v"]))
    state, asks = None, corpus.where("g >= 0").select("g", F.explode("asks").alias("a"))
    dishes = corpus.where("g >= 0")
    answer = "g int, kind string, h int, blob binary"
    for r in range(rounds):
        replies = asks.select("g", "a.h", "a.blob").groupBy("h").applyInPandas(_answer(groups), answer)
        told = replies.where("kind = 'tables'")
        if state is not None:
            told = told.unionByName(state.select("g", "kind", "h", "blob"))
        passed = dishes.select("g", "dishes").groupBy("g").cogroup(told.groupBy("g")) \
            .applyInPandas(_sampler(groups, hot, now, sweeps, moves, seed + r, r == rounds - 1), PASSED)
        state = cut_lineage(passed, replaces=state)
        cold = state.agg(F.coalesce(F.sum("k"), F.lit(0.0)), F.coalesce(F.sum("s"), F.lit(0.0))).first()
        _, hot_k, hot_t = hot_sums(state)
        now = totals(float(cold[0]), float(cold[1]))
        asks = state.select("g", F.explode("asks").alias("a"))
    replies = asks.select("g", "a.h", "a.blob").groupBy("h").applyInPandas(_answer(groups), answer) \
        .unionByName(state.select("g", "kind", "h", "blob"))
    parts = dishes.select("g", "dishes", "tokens").groupBy("g").cogroup(replies.groupBy("g")) \
        .applyInPandas(_scorer(hot, now), "chunk long, blob binary, ids array<string>")
    start = np.log10((strength + d1 * hot_t[-1]) / (strength + start_docs)) if start_docs else 0.0
    meta = corpus.where("g < 0").select("chunk", F.col("meta").alias("blob"), "ids")
    out = cut_lineage(parts.unionByName(meta).groupBy("chunk").applyInPandas(
        _documents(now, float(start)), "id string, held_out boolean, n_tokens long, n_known long, base_score double, score double"))
    spark.sql(f"DROP TABLE {name}")
    drop_path(spark, path)
    drop_lineage(state)
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "held_out", "n_tokens", "n_known",
                      F.lit(now.n).cast("long").alias("train_tokens"), "base_score", "score")


def perplexity(scored: DataFrame) -> DataFrame:
    """``(held_out, n_tokens, perplexity, base_perplexity)`` of learned-from and held-out rows."""
    return scored.groupBy("held_out").agg(
        F.sum("n_tokens").alias("n_tokens"), F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"),
        F.pow(F.lit(10.0), -F.sum("base_score") / F.sum("n_tokens")).alias("base_perplexity"))
