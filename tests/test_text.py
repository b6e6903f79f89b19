"""Chunking, packing, tokens and templates (FIXTURES §3-4, SURVEY card A7/A8)."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.functions.dates import parse_period
from quarry.functions.text import fill_template
from quarry.operators.chunking import recursive_chunks, window_chunks
from quarry.operators.pipelines import register_splitter_udtf, split_text
from quarry.operators.summarize import Extractive, generate_column


def test_window_chunk_counts(spark):
    df = spark.createDataFrame([(n, "x" * n) for n in (0, 1, 600, 601)], "n int, t string")
    got = {r["n"]: r["k"] for r in df.select("n", F.size(window_chunks("t")).alias("k")).collect()}
    assert got == {0: 0, 1: 1, 600: 1, 601: 2}


def _check_chunks(text, chunks):
    assert all(0 < len(c) <= 600 for c in chunks)
    if len(text) <= 600 and text.strip():
        assert chunks == [text.strip()]
    joined = "".join(chunks)
    # every non-space character of the input appears, in order
    it = iter(joined)
    assert all(any(ch == x for x in it) for ch in text if not ch.isspace())


def test_recursive_chunks_native_against_the_row_helper(spark):
    rng = random.Random(5)
    texts = ["Word " * 150 + "\n\n" + ("line of text\n" * 80) + "\n\n" + "y" * 1500, "", " \n ", "a", None, "x" * 600, "x" * 601, "\n\n" * 400,
             "é" * 700 + " " + "z" * 20, "a.b*c\n\n[d]" * 100]
    texts += ["".join(rng.choice("ab  \n" if i % 2 else "abcdefgh \n") * rng.choice([1, 1, 1, 40]) for _ in range(rng.randrange(600))) for i in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    for size, overlap in ((600, 100), (20, 5), (7, 0)):
        got = {r["i"]: r["c"] for r in df.select("i", recursive_chunks("t", size, overlap).alias("c")).collect()}
        for i, t in enumerate(texts):
            assert got[i] == split_text(t or "", size, overlap), (size, i)
    for i, t in enumerate(texts):
        _check_chunks(t or "", split_text(t or ""))
    assert "y" * 600 in split_text(texts[0])
    plan = df.select(recursive_chunks("t"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_splitter_table_function(spark):
    register_splitter_udtf(spark)
    got = spark.sql("SELECT * FROM split_text('aa bb cc dd', 5, 3) ORDER BY split_idx").collect()
    assert [tuple(r) for r in got] == list(enumerate(split_text("aa bb cc dd", 5, 3))) and len(got) > 1


@pytest.mark.parametrize("p,ok", [("30d", 30), ("0d", 0), ("30", None), ("d", None), ("1w", None), ("-5d", None)])
def test_period_parsing(p, ok):
    if ok is None:
        with pytest.raises(ValueError):
            parse_period(p)
    else:
        assert parse_period(p) == ok


def test_template_placeholders_checked_at_plan_time():
    with pytest.raises(ValueError):
        fill_template("Q: {question}", context=F.lit("x"))


def sentences_of(prompt, most=3, budget=None):
    """The default summary of one prompt, in Python."""
    sents = [x for x in (x.strip(" \t\n\r\f") for x in re.sub(r"([.!?])[ \t\n\r\f]+", "\\1\n", prompt or "").split("\n")) if x]
    words = [Counter(re.findall(r"[^\W_]+", s.lower())) for s in sents]
    df = Counter(w for c in words for w in c)
    score = [round(sum(n * math.log(len(sents) / df[w]) for w, n in c.items()), 9) for c in words]
    best = sorted(sorted(range(len(sents)), key=lambda i: (-score[i], i))[:most])
    return " ".join(" ".join(sents[i] for i in best).split(" ")[:budget])


def test_extractive_summaries_against_python(spark):
    rng = random.Random(2)
    prompts = [" ".join(f"Sentence {i} talks about topic {rng.randrange(5)}{rng.choice('.!?')}" + rng.choice([" ", "\n", "  "]) for i in range(n))
               for n in (0, 1, 2, 3, 4, 20, 60)] + [None, "", "...", "No end", "A. a. A. b. A.", "3.14 is pi. 2.71 is e.\n\nx\ty"]
    df = spark.createDataFrame([(i, "k", p) for i, p in enumerate(prompts)] + [(0, "k", prompts[6])], "i int, n string, prompt string")
    got = generate_column(df, "prompt").collect()
    assert sorted((r["i"], r["generated"]) for r in got) == sorted([(i, sentences_of(p)) for i, p in enumerate(prompts)] + [(0, sentences_of(prompts[6]))])
    few = generate_column(df, "prompt", Extractive("{x} talks about {y}", max_sentences=2, max_words=4), "s").collect()
    assert all(len(r["s"].split(" ")) <= 4 and "talks" not in r["s"] for r in few)
    assert generate_column(df.where("false"), "prompt").count() == 0


def _check_greedy(rows, limit, overhead, sep):
    """Windows are runs of the order; each fits or is one document; the next document would not have fitted."""
    groups = {}
    for g, o, t, w in sorted(rows, key=lambda r: (str(r[0]), r[1], r[3])):
        groups.setdefault(g, {}).setdefault(w, []).append(t)
    for wins in groups.values():
        assert sorted(wins) == list(range(len(wins)))
        size = lambda ts: overhead + sum(ts) + sep * (len(ts) - 1)
        for w, ts in wins.items():
            assert len(ts) == 1 or size(ts) <= limit
            if w + 1 in wins:
                assert size(ts + wins[w + 1][:1]) > limit


@pytest.mark.parametrize("limit,overhead,sep,least", [(12, 0, 0, 1), (20, 3, 1, 0), (9, 0, 2, 1), (25, 2, 0, 0), (5, 9, 0, 0)])
def test_packing_is_greedy(spark, limit, overhead, sep, least):
    import numpy as np

    from quarry.operators.summarize import pack_windows
    rng = np.random.default_rng(limit + overhead + sep)
    rows = [(int(g) if g else None, int(i), int(rng.integers(least, 9)) if rng.random() < 0.9 else 40)
            for g in range(3) for i in range(rng.integers(50, 200))]
    s = spark.createDataFrame(rows, "g int, o long, t long")
    got = [tuple(r) for r in pack_windows(s, ["g"], "o", "t", limit, overhead, sep).select("g", "o", "t", "window").collect()]
    assert sorted((str(g), o, t) for g, o, t, _ in got) == sorted((str(g), o, t) for g, o, t in rows)
    _check_greedy(got, limit, overhead, sep)


def test_packing_hand_cases(spark):
    from quarry.operators.summarize import pack_windows

    def pack(ts, limit, overhead=0, sep=0):
        s = spark.createDataFrame([(None, i, t) for i, t in enumerate(ts)], "g int, o long, t long")
        return [r["window"] for r in pack_windows(s, ["g"], "o", "t", limit, overhead, sep).orderBy("o").collect()]
    assert pack([3000, 2000, 2000, 7000, 100, 100], 6000) == [0, 0, 1, 2, 3, 3]
    assert pack([0, 0, 5, 0, 9, 0, 0, 1, 0], 5) == [0, 0, 0, 0, 1, 2, 2, 2, 2]
    assert pack([0, 0, 0], 5) == [0, 0, 0]
    assert pack([1, 1], 3, 5) == [0, 1]


def test_packing_keeps_null_groups_and_equal_orders(spark):
    from quarry.operators.summarize import pack_windows
    rows = [(None, 1, 2), (None, 1, 2), (None, None, 2), ("a", 1, 2), ("a", 1, 2), ("a", 1, 2)]
    s = spark.createDataFrame(rows, "g string, o long, t long")
    got = pack_windows(s, ["g"], "o", "t", 4).collect()
    assert sorted(map(str, (tuple(r)[:3] for r in got))) == sorted(map(str, rows))
    assert sorted(r["window"] for r in got if r["g"] == "a") == [0, 0, 1]


def test_summaries_terminate_one_row_per_group(spark):
    from quarry.operators.summarize import map_reduce_summary, prompt_docs, recursive_summary
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    langs = {r["lang"] for r in d.select("lang").distinct().collect()}
    mr = map_reduce_summary(d, ["lang"], "doc_id", "text").collect()
    assert {r["lang"] for r in mr} == langs and all(r["summary"] for r in mr)
    p = prompt_docs(d, "doc_id", "text", ["doc_id", "lang"])
    rs = recursive_summary(p, ["lang"], "doc_id", "page_content").collect()
    assert {r["lang"] for r in rs} == langs and all(r["levels"] <= 20 for r in rs)


def test_summaries_take_text_keys_and_any_counter(spark):
    from quarry.operators.chunking import chunk
    from quarry.operators.summarize import map_reduce_summary, pack_windows, recursive_summary
    words = F.pandas_udf(lambda s: s.str.count(r"[^\W\d_]+|\d+|[^\s\w]|_").astype("int32"), "int")
    rows = [(f"http://a/{i:03d}", "g", " ".join(f"w{j} x{i * j % 7}." for j in range(i % 40))) for i in range(60)] + [(None, "g", None)]
    d = spark.createDataFrame(rows, "o string, g string, c string")
    for counter in ("regex", words):
        rs = recursive_summary(d, ["g"], "o", "c", limit=120, template="{text}", mode=counter).collect()
        mr = map_reduce_summary(d, ["g"], "o", "c", chunk_tokens=40, token_max=90, mode=counter).collect()
        assert len(rs) == len(mr) == 1 and rs[0]["summary"] and mr[0]["summary"]
        if counter == "regex":
            want = rs[0]["summary"], mr[0]["summary"]
    assert (rs[0]["summary"], mr[0]["summary"]) == want                        # the same counts, the same result
    big = spark.createDataFrame([(2 ** 60 + i, "g", f"one two three {i}.") for i in range(9)], "o long, g string, c string")
    assert map_reduce_summary(big, ["g"], "o", "c", token_max=12).count() == 1
    t = d.select("o", "g", F.col("c"))
    packed = {}
    for counter in ("regex", words):
        from quarry.functions.text import token_count
        p = pack_windows(t.withColumn("n", token_count("c", counter)), ["g"], "o", "n", 100)
        packed[str(counter)] = sorted((str(r["o"]), r["window"]) for r in p.collect())
    assert len(set(map(str, packed.values()))) == 1
    text = spark.createDataFrame([(1, "a b\n\nc d e\n\n\n f"), (1, None), (2, "")], "k int, t string")
    a = chunk(text, "t", "k", mode="tokens", max_tokens=3).select("k", "split_idx", "chunk")
    b = chunk(text, "t", "k", mode="tokens", max_tokens=3, counter=words).select("k", "split_idx", "chunk")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_every_group_is_summarised_even_without_progress(spark):
    from quarry.operators.summarize import map_reduce_summary, recursive_summary
    rows = [(g, i, "word " * 30) for g in ("a", "b", None) for i in range(6)]
    d = spark.createDataFrame(rows, "g string, o long, c string")
    same = lambda prompts: ["word " * 200 for _ in prompts]
    rs = recursive_summary(d, ["g"], "o", "c", generate=same, limit=60).collect()
    assert {r["g"] for r in rs} == {"a", "b", None} and len(rs) == 3
    mr = map_reduce_summary(d, ["g"], "o", "c", generate_map=same, generate_reduce=same, token_max=100).collect()
    assert {r["g"] for r in mr} == {"a", "b", None} and len(mr) == 3


def test_default_generator_scores_prompts_where_they_lie(spark):
    from quarry.operators.summarize import extractive_generator, generate_column
    rows = [(1, "A a. B b! a b? C"), (2, None), (3, "... !!!"), (4, "one one two. two. three")]
    out = generate_column(spark.createDataFrame(rows, "k int, p string"), "p", extractive_generator("{t}", max_sentences=2), "s")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.columns == ["k", "p", "s"]
    # scores: "A a." 2 ln 2, "B b!" 2 ln 2, "a b?" 2 ln 2, "C" ln 4; "one one two." 2 ln 3 + ln 1.5, "two." ln 1.5, "three" ln 3
    assert {r["k"]: r["s"] for r in out.collect()} == {1: "A a. B b!", 2: "", 3: "... !!!", 4: "one one two. three"}
