"""Near-duplicate operators against brute force, with small tiles and salts."""

import random

import numpy as np
import pytest

from quarry.llm import jaccard, neardup, shingles


def _components(n, links):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def _words(text):
    out, cur = [], []
    for ch in text + " ":
        if ch not in " \t\n\x0b\f\r":
            cur.append(ch.lower() if "A" <= ch <= "Z" else ch)
        elif cur:
            out.append("".join(cur))
            cur = []
    return out


def _shingles(text):
    w = _words(text or "")
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def _texts(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocab, k=70)
    base = [rng.choices(vocab, k=rng.randint(3, 120)) for _ in range(n // 4)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        kind = rng.random()
        if kind < 0.2:
            w = rng.choices(vocab, k=rng.randint(1, 100))
        elif kind < 0.75:
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        if rng.random() < 0.4:
            at = rng.randint(0, len(w))
            w[at:at] = passage
        out.append(rng.choice([" ", "  ", "\n"]).join(x.upper() if rng.random() < 0.1 else x for x in w))
    return out


def _brute(docs):
    sets = [_shingles(t) for _, t in docs]
    links = [(a, b) for a in range(len(docs)) for b in range(a) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = _components(len(docs), links)
    out = []
    for i, (d, _) in enumerate(docs):
        ids = [docs[j][0] for j in range(len(docs)) if comp[j] == comp[i] and docs[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if ids else None))
    return out


key = lambda r: tuple((x is None, x or 0) for x in r)


@pytest.mark.parametrize("tile,salt,frequent", [(2048, 4096, 1 << 20), (3, 2, 0)])
def test_jaccard_components_against_brute_force(spark, monkeypatch, tile, salt, frequent):
    monkeypatch.setattr(jaccard, "SALT_ROWS", salt)
    texts = _texts(tile, 140)
    docs = [(3 * i - 50, t) for i, t in enumerate(texts)] + [(9001, None), (9002, ""), (9003, " \n"), (9004, "one two"), (9005, "ONE  two"),
                                                         (9005, "ONE  two"), (None, texts[0]), (None, None), (9006, "x " * 30_000)]
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id long, text string, k1 int, block string").repartition(5)
    got = jaccard.jaccard_components(df, tile=tile, max_frequent=frequent).collect()
    assert sorted(map(tuple, got), key=key) == sorted(_brute(docs), key=key)


def test_jaccard_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_components(df).collect() == []


def test_trie_links_against_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(2, 25)
        base = [set(rng.sample(range(60), rng.randint(1, 30))) for _ in range(4)]
        raw = {frozenset(s ^ set(rng.sample(range(60), rng.randint(0, 3)))) for s in rng.choices(base, k=n)} - {frozenset()}
        raw = sorted(raw, key=sorted)
        arrays = [np.array(sorted(s), np.uint64) for s in raw]
        links = [(a, b) for a in range(len(raw)) for b in range(a) if 100 * len(raw[a] & raw[b]) >= 80 * len(raw[a] | raw[b])]
        got = jaccard.trie_links(arrays) if arrays else []
        assert _components(len(raw), got) == _components(len(raw), links)


def test_linked_sets_share_posted_shingles():
    rng = random.Random(8)
    for _ in range(400):
        n = rng.randint(1, 300)
        x = set(rng.sample(range(2000), n))
        y = set(x)
        for _ in range(rng.randint(0, max(1, n // 6))):
            y.discard(rng.choice(sorted(y))) if len(y) > 1 and rng.random() < 0.5 else y.add(rng.randint(0, 2000))
        if 100 * len(x & y) < 80 * len(x | y):
            continue
        order = {t: rng.random() for t in x | y}
        post = [set(sorted(s, key=order.get)[:jaccard.prefix_length(len(s))]) for s in (x, y)]
        assert len(post[0] & post[1]) >= min(jaccard.least_shared(len(x)), jaccard.least_shared(len(y)))


def test_shingle_sets_match_plain_python():
    texts = _texts(9, 50) + [None, "", "a", "É é A", "a\x0bb\x0cc d\re", "word " * 4]
    long = " ".join(f"t{i % 977}" for i in range(400_000))
    for t, s in zip(texts + [long], shingles.sets(texts + [long])):
        assert s.size == len(_shingles(t)) and (np.diff(s.astype(object)) > 0).all()
    a, b = shingles.sets(["A b c d e f", "a  B\nc d E f"])
    assert (a == b).all()


def _vectors(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for label in (0, 1, 2):
        base = rng.standard_normal((12, 16))
        for i in range(90):
            v = base[rng.integers(12)] + rng.standard_normal(16) * rng.choice([0.0, 0.02, 0.1, 0.12, 1.0])
            rows.append((label, v * rng.choice([1.0, 3.0])))
    return [(i * 2, lab, [float(np.float32(x)) for x in v]) for i, (lab, v) in enumerate(rows)]


@pytest.mark.parametrize("tile", [1024, 8])
def test_near_duplicate_vectors_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(neardup, "TILE", tile)
    rows = _vectors(2)
    rows += [(1001, 0, rows[0][2]), (1003, 1, rows[0][2]), (1005, None, rows[0][2]), (1007, 0, None), (1009, 0, [0.0] * 16),
             (1011, 0, [float("nan")] * 16), (1013, 0, [None] + [1.0] * 15), (1015, 0, [1.0, 2.0]), (1017, 0, [2.0, 4.0]),
             (1017, 0, [2.0, 4.0]), (None, 0, rows[0][2]), (1019, 0, []), (1021, 0, [float("inf")] + [0.0] * 15)]
    ok = [r for r in rows if r[0] is not None and r[1] is not None and r[2] and None not in r[2]
          and np.isfinite(r[2]).all() and any(r[2])]
    unit = [np.asarray(v) / np.linalg.norm(v) for _, _, v in ok]
    links = [(a, b) for a in range(len(ok)) for b in range(a) if ok[a][1] == ok[b][1] and len(unit[a]) == len(unit[b])
             and float(unit[a] @ unit[b]) >= 0.98]
    comp = _components(len(ok), links)
    want = []
    for i, (vid, _, _) in enumerate(ok):
        c = min(ok[j][0] for j in range(len(ok)) if comp[j] == comp[i])
        want.append((vid, sum(i in p for p in links), c, vid == c))
    ids = [r[0] for r in ok]
    want += [(r[0], 0, r[0], r[0] is not None) for r in rows if r not in ok] if True else []
    df = spark.createDataFrame([(*r, 1, "x") for r in rows],
                               "vec_id long, label int, embedding array<float>, n int, cells string").repartition(3)
    got = [tuple(r) for r in neardup.near_duplicates(df).collect()]
    nan_rows = {1011}
    assert len(got) == len(rows) and ids
    assert sorted((g for g in got if g[0] not in nan_rows), key=key) == sorted((w for w in want if w[0] not in nan_rows), key=key)
    assert [g for g in got if g[0] in nan_rows] == [(1011, 0, 1011, True)]


def test_near_duplicate_calibration_reaches_its_recall():
    plan = neardup.calibrate(100_000, 0.98, 0.999)
    rng = np.random.default_rng(4)
    d = 64
    u = rng.standard_normal((3000, d))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.standard_normal((3000, d))
    w -= (w * u).sum(1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    v = 0.98 * u + np.sqrt(1 - 0.98**2) * w                      # pairs just at the threshold
    dirs, offset = plan.directions(d)
    width = neardup.CELL_SIGMAS * plan.sigma / np.sqrt(d)
    cu, cv = (np.floor(x @ dirs / width + offset).reshape(3000, plan.k, plan.passes) for x in (u, v))
    met = (cu == cv).all(1).any(1)
    count = (np.abs((u - v) @ dirs) <= neardup.WINDOW_SIGMAS * plan.sigma / np.sqrt(d)).sum(1) >= plan.min_count
    assert (met & count).mean() >= 0.995
    far = (np.abs((u - u[::-1]) @ dirs) <= neardup.WINDOW_SIGMAS * plan.sigma / np.sqrt(d)).sum(1) >= plan.min_count
    assert far.mean() < 0.01


def test_near_duplicates_empty_table(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).count() == 0


def test_sets_and_keys_of_many_texts_are_those_of_each():
    base, one = 0x9E3779B97F4A7C15, (1 << 64) - 1
    texts = ["", None, " a  b", "One two\tthree four five six one two three four five", "x" * 5000 + " y z u v w", "é ü " * 7, "b c d e f " * 9000]
    words = [w for t in texts for w in (t or "").encode().lower().split()]
    got, start = shingles._word_hashes(b" \n".join((t or "").encode().lower() for t in texts))
    assert start.size == len(words)
    for w, h in zip(words, got.tolist()):
        plain = sum((c + 1) * pow(base, (i & 4095) + 1, 1 << 64) for i, c in enumerate(w)) & one
        assert h == int(shingles.mix(np.array([(plain + len(w)) & one], np.uint64))[0])
    each = [next(shingles.sets([t])) for t in texts]
    many = list(jaccard.keyed_sets(texts))
    assert [s.tolist() for s, _ in many] == [s.tolist() for s in each]
    assert [k for _, k in many] == [jaccard.set_key(s) for s in each]


def test_prefix_looks_up_what_may_be_frequent():
    rng = np.random.default_rng(3)
    s = np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64) << np.uint64(1))
    frequent = np.sort(np.concatenate([s[rng.permutation(s.size)[:350]], rng.integers(0, 1 << 63, 5000).astype(np.uint64)]))
    counts = rng.integers(2, 9, frequent.size).astype(np.int32)
    known = dict(zip(frequent.tolist(), counts.tolist()))
    t, c = jaccard._prefix(s, frequent, counts, jaccard._known(frequent))
    order = sorted(s.tolist(), key=lambda x: (known.get(x, 0), x))[:jaccard.prefix_length(s.size)]
    assert t.tolist() == order and c.tolist() == [known.get(x, 0) for x in order]


def test_narrow_rows_are_not_counted_in_bytes(spark, monkeypatch):
    seen, name = [], "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    monkeypatch.setattr(jaccard, "_shared", lambda post, f=jaccard._shared: seen.append(spark.conf.get(name)) or f(post))
    df = spark.createDataFrame([(i, f"a b c d e f g h {i // 3}") for i in range(12)], "doc_id long, text string")
    assert len({r["component_id"] for r in jaccard.jaccard_components(df).collect()}) == 4
    assert seen == [str(2 ** 31 - 1)] and spark.conf.get(name) == before
