"""Phrase collocations: counts and ranks by Python, collisions, edge rows."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarry.llm import collocations as C
from quarry.llm.blobs import deltas, narrow, pack, range_of, undelta, unpack

SF = "/root/testdata/sf0.001"


def pieces(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", text)]


def brute(rows, least, top, longest=3):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f[lang][tuple(words[i:i + m])] += 1
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) >= 2 and a >= least}
        kept = []
        for p, a in cand.items():
            cuts = [(1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            inside = any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                         for q, b in cand.items())
            if not inside:
                kept.append((score, a, " ".join(p), c[p[:k]], c[p[k:]]))
        kept.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i + 1, p, a, l, r, n[lang], s) for i, (s, a, p, l, r) in enumerate(kept[:top])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize("least,top,longest", [(10, 2000, 3), (4, 25, 4)])
def test_against_python(spark, least, top, longest):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r["lang"], r["text"]) for r in docs.collect()], least, top, longest)
    got = rows_of(C.collocations(docs.repartition(3), top, least, longest, chunk_words=3000))
    assert got == want and len(got) > 20


def test_edge_rows(spark):
    rows = [("en", "Big Cat, big  cat\tbig cat.big cat"), (None, "a b a b a b\x0ba b"), ("und", "a b"), ("en", None), ("en", ""), (None, " \t. ,"),
            ("de", "x " * 50), ("en", "big cat" * 1), ("en", "big cat"), ("fr", "é è " * 3 + "\r\né è"), ("zz", "y" * 3_000_000 + " q " * 700_000)]
    df = spark.createDataFrame([(a, b, "c", 1) for a, b in rows], "lang string, text string, phrase string, n int")
    assert rows_of(C.collocations(df, min_count=3)) == brute(rows, 3, 2000)
    empty = C.collocations(df.where("false"))
    assert empty.count() == 0 and empty.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_products_beyond_64_bits(spark):
    big = 4_000_000_000
    rows = [("en", 1, "a", 2 * big, ), ("en", 1, "b", 2 * big + 1), ("en", 2, "a b", big), ("en", 0, "", 10 * big)]
    got = C.scored(spark.createDataFrame(rows, "lang string, n int, phrase string, f long")).first()
    assert got["score"] == 1000000 * big * big // (2 * big * (2 * big + 1)) == 249999


def test_a_collision_repeats_the_count_with_other_polynomials(spark, monkeypatch):
    docs = spark.createDataFrame([("en", "red fox. red fox. red fox. blue owl. blue owl. blue owl.")] * 2, "lang string, text string")
    seen, real = [], C._reader

    def reader(seed):
        seen.append(seed)
        run = real(seed)

        def broken(batches):
            for pdf in run(batches):
                if seed == C.SEED:
                    pdf["ok"] = False
                yield pdf
        return broken
    monkeypatch.setattr(C, "_reader", reader)
    got = rows_of(C.collocations(docs, min_count=3))
    assert [r[2] for r in got] == ["blue owl", "red fox"] and seen == [C.SEED, C.SEED + 1]


def test_rehash_finds_wrong_pointers():
    import pandas as pd
    grams = C.Grams(1)
    grams.add(next(C.blocks([b"one two three"])), 0)
    words = grams.take()
    langs = np.array([C.lang_code("en", 1)])
    fp, chk, _ = grams.ngrams(words, langs, 2)
    rows = pd.DataFrame({"lang": "en", "n": 2, "fp": fp.view(np.int64), "chk": chk.astype(int)})
    assert C.rehash([b"one two", b"two three"], rows, 1).tolist() == [True, True]
    assert C.rehash([b"one two", b"two four"], rows, 1).tolist() == [True, False]
    assert C.rehash([b"", b"two three x"], rows, 1).tolist() == [False, False]


def test_packed_arrays_and_ranges():
    rng = np.random.default_rng(0)
    keys = np.sort(rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    small = rng.integers(0, 300, 77)
    a, b, c, d = unpack(pack(deltas(keys), narrow(small), np.zeros(0, np.int64), np.arange(3.0)))
    assert (undelta(a) == keys).all() and (b == small).all() and b.dtype == np.uint16 and c.size == 0 and (d == np.arange(3.0)).all()
    g = range_of(keys, 7)
    assert (np.diff(g.astype(int)) >= 0).all() and set(g) == set(range(7))
