"""Learned operators and the tokenizer: exact parts by brute force, quality by held-out rows, edge rows."""

import itertools
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from quarry.llm import labelled, langid, mixing, quality, spm, toxicity
from quarry.llm.queries import QUERIES, SP_MODEL

SF = "/root/testdata/sf0.01"


# -- conditional random field ------------------------------------------------------------------

def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(1)
    lengths = np.array([1, 4, 3])
    starts = np.array([0, 1, 5])
    emit, trans, begin = rng.random((8, 3)) + 0.1, rng.random((3, 3)) + 0.1, rng.random(3) + 0.1
    post, counts = langid.forward_backward(emit, trans, begin, starts, lengths, pairs=True)
    want, pair = np.zeros((8, 3)), np.zeros((3, 3))
    for s, n in zip(starts, lengths):
        weights = {}
        for path in itertools.product(range(3), repeat=int(n)):
            w = begin[path[0]] * emit[s, path[0]]
            for t in range(1, n):
                w *= trans[path[t - 1], path[t]] * emit[s + t, path[t]]
            weights[path] = w
        z = sum(weights.values())
        for path, w in weights.items():
            for t, y in enumerate(path):
                want[s + t, y] += w / z
            for a, b in zip(path, path[1:]):
                pair[a, b] += w / z
    assert np.allclose(post, want) and np.allclose(counts, pair)


def test_words_and_long_texts_in_pieces():
    text = "Ab  cd-é\n" + "xyz " * 300
    w = langid.Words(text.lower().encode())
    assert w.n == 303 and w.chains()[1].max() <= langid.CHAIN and w.fresh[3]
    data = b"ab cd\n" * 1000
    assert b"".join(langid.pieces(data, 100)) == data and all(x.endswith((b"\n", b" ")) for x in langid.pieces(data, 100))
    assert b"".join(langid.pieces(b"x" * 250, 100)) == b"x" * 250


def test_crf_separates_languages_and_code_switching(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    crf = langid.fit(docs, labelled.fold("doc_id", 5) != 0, max_per_lang=60)
    held = docs.where(labelled.fold("doc_id", 5) == 0).select("text", "lang").toPandas()
    total = crf.documents(list(held.text))
    acc = (np.array(crf.langs)[total.argmax(1)] == held.lang.values).mean()
    assert acc >= 0.95
    one = crf.documents([held.text[0]])                       # alone or in a batch: the same
    assert np.allclose(one[0], total[0])
    en, de = (" ".join(held.text[(held.lang == x).values].iloc[0].split()[:15]) for x in ("en", "de"))
    w = langid.Words((en + " " + de).replace("\n", " ").lower().encode())
    words = [crf.langs[i] for i in crf.posteriors(w).argmax(1)]
    assert words[2] == "en" and words[-3] == "de"
    assert (np.diag(crf.trans) > crf.trans.max(1) - 1e-9).all()   # staying is likelier than switching


def test_langid_edge_rows(spark):
    rows = [(1, "the and of", "en", 1), (2, None, "en", 1), (3, "", None, 1), (4, "12 !!", "de", 1), (None, "und der die", "de", 1),
            (5, "und der die", "de", 1), (5, "und der die", "de", 1), (6, "the " * 50_000, "en", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    from pyspark.sql import functions as F
    score = langid.scorer(langid.fit(df, F.lit(True)))
    got = df.select("doc_id", score("text").alias("s")).select("doc_id", "s.lang_pred", "s.score").collect()
    assert [r["lang_pred"] for r in got] == ["en", "und", "und", "und", "de", "de", "de", "en"]
    assert all(0 <= r["score"] <= 1 for r in got)
    empty = df.limit(0)
    assert langid.fit(empty, F.lit(True)) is None
    assert df.select(langid.scorer(None)("text").alias("s")).first()["s"]["lang_pred"] == "und"
    assert empty.select(score("text")).count() == 0


def test_langid_learns_languages_of_long_texts_only(spark):
    from pyspark.sql import functions as F
    de, fr, digits = "und der die das ist nicht " * 1200, "les des une est dans pour " * 1200, "12 34\n" * 9000
    rows = [(1, de, "de"), (2, de[4:], "de"), (3, fr, "fr"), (4, digits + "kuka mikin hyvin", "fi"), (5, digits, "xx")]
    rows += [(10 + i, "77 88", "fr") for i in range(30)]          # no letter: takes no place in the sample
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    crf = langid.fit(df, F.lit(True), max_per_lang=2)
    assert crf.langs == ["de", "fi", "fr"]
    cut = {r["doc_id"]: r["t"] for r in df.select("doc_id", langid.training_text(F.col("text"), F.col("doc_id")).alias("t")).collect()}
    assert all(len(t) <= langid.MAX_TRAIN_CHARS for t in cut.values()) and len(cut[1]) > 0.9 * langid.MAX_TRAIN_CHARS
    assert set(cut[1].split()) == set(de.split()) and "kuka" in cut[4] and cut[10] == "77 88"
    got = df.select("doc_id", langid.scorer(crf)("text").alias("s")).select("doc_id", "s.lang_pred").collect()
    assert [r["lang_pred"] for r in got[:3]] == ["de", "de", "fr"] and got[4]["lang_pred"] == "und"


# -- boosted trees -----------------------------------------------------------------------------

def test_flattened_trees_against_row_wise_walk():
    rng = np.random.default_rng(2)
    x = rng.random((400, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    m = quality.fit_trees(x, y, trees=15, depth=3)
    for r in range(0, 400, 37):
        s = m.base
        for t in range(15):
            node = 0
            for _ in range(3):
                node = 2 * node + 1 + int(x[r, m.feature[t, node]] > m.threshold[t, node])
            s += m.value[t, node - 7]
        assert math.isclose(s, m.margin(x[r:r + 1])[0], rel_tol=1e-12)
    assert ((m.predict(x) > 0.5) == y).mean() > 0.97
    assert np.allclose(quality.fit_trees(x, np.ones(400)).predict(x), 401 / 402)
    assert np.allclose(quality.fit_trees(x[:0], y[:0]).predict(x), 0.5)


def test_quality_held_out(spark):
    df = QUERIES["op8_quality"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    held = df[df.held_out]
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == h for i, h in zip(df.doc_id, df.held_out))
    assert (held.predicted == held.quality).mean() >= 0.93


def test_quality_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "fine words here.\n" * 9000, 1), (3, "x", 1), (None, "AA!! " * 5, 1)],
                                 "doc_id long, text string, y int")
    labels = spark.createDataFrame([(1, None), (3, 1), (None, 0), (99, 0)], "doc_id long, quality int")
    from pyspark.sql import functions as F
    score = quality.scorer(quality.fit(docs, labels, F.lit(True)))
    got = [r[0] for r in docs.select(score("text")).collect()]
    assert all(0 <= s <= 1 for s in got) and got[0] == got[1]
    assert docs.limit(0).select(score("text")).count() == 0


# -- nearest labelled examples -----------------------------------------------------------------

def test_block_max_search_is_exact():
    rng = random.Random(3)
    vectors = []
    for _ in range(300):
        v = {t: rng.random() for t in rng.sample(range(40), rng.randint(1, 6))}
        n = math.sqrt(sum(w * w for w in v.values()))
        vectors.append({t: w / n for t, w in v.items()})
    vectors[17] = dict(vectors[200])                         # a tie
    index = toxicity.Index(vectors, 40, block=16)
    for q, skip in [(vectors[i], s) for i in range(0, 300, 7) for s in (-1, i)] + [({50: 1.0}, -1)]:
        cos = [(sum(w * v.get(t, 0.0) for t, w in q.items()), i) for i, v in enumerate(vectors) if i != skip]
        want = sorted((c for c in cos if c[0] > 1e-12), key=lambda c: (-round(c[0], 12), c[1]))[:9]
        got = index.nearest(q, 9, skip=skip)
        assert [round(c, 9) for c, _ in got] == [round(c, 9) for c, _ in want]
        assert {i for c, i in got if c > got[-1][0] + 1e-9} == {i for c, i in want if c > want[-1][0] + 1e-9} if got else not want


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    df = QUERIES["op9_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    held = df[df.held_out]
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) == h for i, h in zip(df.doc_id, df.held_out))
    assert (held.predicted == held.toxic).mean() >= 0.96
    assert held.predicted[held.toxic == 1].mean() >= 0.8 and held.predicted[held.toxic == 0].mean() <= 0.02
    assert all(len(e) > 0 for e in df.evidence[df.predicted == 1])


def test_toxicity_edge_rows(spark):
    from pyspark.sql import functions as F
    docs = spark.createDataFrame([(i, ["bad words", "good words", None, ""][i % 4], 0) for i in range(40)] + [(None, "bad", 0)],
                                 "doc_id long, text string, label int")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True), min_g=0.1)
    got = docs.select("text", toxicity.scorer(model)("text").alias("s")).select("text", "s.score").collect()
    assert all(0 <= r["score"] <= 1 for r in got)
    none = toxicity.fit(docs, labels.where("toxic = 0"), F.lit(True))
    assert none.index is None and docs.select(toxicity.scorer(none)("text").alias("s")).first()["s"]["evidence"] == []
    assert docs.limit(0).select(toxicity.scorer(model)("text")).count() == 0


def test_toxicity_rare_words_find_their_neighbours(spark):
    from pyspark.sql import functions as F
    rng = random.Random(8)
    clean = [" ".join(rng.choices([f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(5)], k=40)) for _ in range(60)]
    toxic = [f"vile {c}" for c in clean[:29]] + ["qarn zubble the frondt ikthar spelg mowt"]
    docs = spark.createDataFrame(list(enumerate(clean + toxic)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 60)) for i in range(90)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    assert model.index.n == 90                               # every example, worded in whatever way
    (score, near), (plain, other) = model.scores(["qarn zubble a frondt ikthar spelg", clean[50]])
    assert near[0]["doc_id"] == 89 and near[0]["cosine"] > 0.7 and score > 0.7
    assert other[0]["doc_id"] == 50 and plain < 0.5
    assert model.scores(["", None, "unheard"]) == [(model.base, [])] * 3


def test_toxicity_long_clean_text_with_one_quoted_word(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, labelled.fold("doc_id", 3) != 1)
    texts = [r["text"] for r in docs.join(labels.where("toxic = 0"), "doc_id").where(labelled.fold("doc_id", 3) == 1)
             .where("size(split(text, ' ')) >= 1500").select("text").collect()]
    assert len(texts) >= 10
    quoted = [f"{t[:len(t) // 2]} idiot {t[len(t) // 2:]}" for t in texts]
    assert np.mean([s >= 0.7 for s, _ in model.scores(quoted)]) <= 0.1
    assert all(near for _, near in model.scores(texts))


# -- mixing ------------------------------------------------------------------------------------

def test_targets_are_filled_by_weight():
    assert mixing.fill_targets(100, [10, 60, 30], [5, 2, 1], 3) == [30, pytest.approx(140 / 3), pytest.approx(70 / 3)]
    assert mixing.fill_targets(0, [], [], 3) == []
    t = mixing.fill_targets(60, [10, 10, 40], [1, 0.0001, 0.0001], 3)
    assert t[0] == 30 and sum(t) == pytest.approx(60)


def test_min_cost_flow_against_enumeration():
    rng = random.Random(4)
    for _ in range(150):
        n_p, n_s = rng.randint(1, 3), rng.randint(1, 3)
        cap = [rng.randint(0, 2) for _ in range(n_p)]
        members = [sorted(rng.sample(range(n_s), rng.randint(1, n_s))) for _ in range(n_p)]
        quota = [rng.randint(0, 4) for _ in range(n_s)]
        got = mixing.min_cost_flow(cap, members, quota, 3)
        cost = lambda taken: sum((u // c + 1) ** 2 for t, c in zip(taken, cap) if c for u in range(t))

        def most(taken):            # tokens that reach quotas, by augmenting unit paths
            units = [p for p, t in enumerate(taken) for _ in range(t)]
            slots = [s for s, q in enumerate(quota) for _ in range(q)]
            match = {}

            def place(u, seen):
                for j, s in enumerate(slots):
                    if s in members[units[u]] and j not in seen:
                        seen.add(j)
                        if j not in match or place(match[j], seen):
                            match[j] = u
                            return True
                return False
            return sum(place(u, set()) for u in range(len(units)))
        assert most(got) == sum(got) and all(t <= 3 * c for t, c in zip(got, cap))
        options = [t for t in itertools.product(*(range(3 * c + 1) for c in cap)) if most(t) == sum(t)]
        best = max(map(sum, options))
        assert sum(got) == best and cost(got) == min(cost(t) for t in options if sum(t) == best)


def test_mix_meets_overlapping_targets(spark):
    from pyspark.sql import functions as F
    rng = random.Random(6)
    rows = [(i, rng.randint(0, 40), [["a"], ["a", "b"], ["b"], [None], ["c"]][min(4, i % 7)], "x") for i in range(2000)]
    rows += [(None, 7, ["a"], "x"), (3, 5, ["a"], "x"), (3, 5, ["a"], "x")]
    df = spark.createDataFrame(rows, "doc_id long, size long, sources array<string>, target string") \
        .select(mixing.seeded_hash(F.col("doc_id"), 7).alias("u"), "size", "sources", "doc_id")
    plan = mixing.plan_mix(df)
    got = mixing.apply_mix(df, plan).collect()
    assert len(got) == len(rows) and all(0 <= r["times"] <= 3 and (r["size"] or not r["times"]) for r in got)
    again = mixing.apply_mix(df.repartition(7), mixing.plan_mix(df.repartition(3))).collect()
    assert Counter(map(str, got)) == Counter(map(str, again))
    taken, target = Counter(), {}
    for r in got:
        taken[r["sources"][0] if len(r["sources"]) == 1 else "ab"] += r["size"] * r["times"]
        if len(r["sources"]) == 1:
            target[r["sources"][0]] = r["target"]
    assert abs(sum(taken.values()) - sum(target.values())) <= 200
    assert all(abs(taken[s] - target[s]) <= 50 for s in ("c", None))
    empty = df.limit(0)
    assert mixing.apply_mix(empty, mixing.plan_mix(empty)).count() == 0


# -- SentencePiece -----------------------------------------------------------------------------

def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(num, value):
    if isinstance(value, bytes):
        return _varint(num << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(num << 3 | 5) + struct.pack("<f", value)
    return _varint(num << 3) + _varint(value)


def _model(pieces, kind, byte_fallback, dummy=1, collapse=1):
    out = b"".join(_field(1, _field(1, p.encode()) + _field(2, float(s)) + _field(3, t)) for p, s, t in pieces)
    out += _field(2, _field(3, kind) + _field(35, byte_fallback))
    return out + _field(3, _field(1, b"identity") + _field(3, dummy) + _field(4, collapse) + _field(5, 1))


SPECIAL = [("<unk>", 0, spm.UNKNOWN), ("<s>", 0, spm.CONTROL), ("</s>", 0, spm.CONTROL)]
BYTES = [(f"<0x{b:02X}>", 0, spm.BYTE) for b in range(256)]
TEXTS = ["hello world", "", "  lo  we ", "he he hell", "wörld \U0001f600", "ohllew", "\n", "</s> <s>", "hellohello worldhello"]


@pytest.mark.parametrize("fallback,dummy,collapse", [(0, 1, 1), (1, 1, 0), (1, 0, 1)])
def test_unigram_model_against_the_library(fallback, dummy, collapse):
    words = ["▁hello", "▁he", "llo", "▁world", "▁w", "or", "ld", "▁", "l", "h", "e", "o", "w", "r", "d", "he", "hell"]
    pieces = SPECIAL + BYTES * fallback + [(w, -1.0 - 0.37 * i, spm.NORMAL) for i, w in enumerate(words)]
    data = _model(pieces, spm.UNIGRAM, fallback, dummy, collapse)
    codec = spm.Codec(data)
    assert spm.verify_parity(codec, data, TEXTS) == []
    if fallback:
        assert codec.decode(codec.encode(TEXTS)) == [codec.surface(t) for t in TEXTS]


def _greedy_bpe(pieces, text):
    """Merge the adjacent pair whose piece has the best score, leftmost first, until none is left."""
    score = {p: s for p, s, t in pieces if t == spm.NORMAL}
    parts = list(text)
    while True:
        found = [(-score[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in score]
        if not found:
            return parts
        i = min(found)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def test_bpe_model_against_plain_merging():
    with open(SP_MODEL, "rb") as f:
        data = f.read()
    codec = spm.Codec(data)
    ids = {p: i for i, (p, _, _) in enumerate(codec.model.pieces)}
    for t in ["hello brave new world", "aa aaa aaaa aaaaa", "été naïve", "mm==--  x"]:
        want = []
        for p in _greedy_bpe(codec.model.pieces, codec.normalize(t)):
            want += [ids[p]] if p in ids else [ids[f"<0x{b:02X}>"] for b in p.encode()]
        assert codec.encode([t])[0].tolist() == want


def test_encoding_table(spark, monkeypatch):
    from pyspark.sql import functions as F
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", F.lit(1).alias("ids"))
    rows = [(-1, None, 1), (-2, "", 1), (-2, "", 1), (None, "</s> x ▁y", 1), (-3, ("long text " * 30_000), 1)]
    df = docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string, ids int"))
    got = spm.encode_table(df, SP_MODEL, ["doc_id"]).collect()
    assert len(got) == docs.count() + 5
    by = {r["doc_id"]: r for r in got}
    assert by[-1]["ids"] == by[-2]["ids"] == []
    assert all(r["round_trip"] for r in got if r["doc_id"] is not None)
    import sentencepiece
    ref = sentencepiece.SentencePieceProcessor(model_file=SP_MODEL)
    for r in df.collect():
        if r["doc_id"] not in (None, -1):
            assert by[r["doc_id"]]["ids"] == ref.encode(r["text"])
    assert spm.encode_table(df.limit(0), SP_MODEL, ["doc_id"]).count() == 0


def test_long_texts_are_cut_without_effect():
    with open(SP_MODEL, "rb") as f:
        codec = spm.Codec(f.read())
    text = codec.normalize("some   words\nand more " * 9000 + "x" * 100_000 + " end")
    cut = codec._cut(text)
    assert len(cut) > 2 and "".join(cut) == text
    whole = codec.tokenizer.encode(text, add_special_tokens=False).ids
    assert [i for c in cut for i in codec.tokenizer.encode(c, add_special_tokens=False).ids] == whole
