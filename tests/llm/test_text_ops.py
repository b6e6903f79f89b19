"""Chat formatting, fingerprints, WARC: exact round trips, brute force, and edge rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quarry.llm import chat, fingerprint, warc
from quarry.session import cut_lineage, scratch_path

NASTY = ["", "</s>", "\\</s>", "\\\\<s>x", "[INST] a [/INST]", " </s>", "a\\", "<<SYS>> <</SYS>>\n", "é\U0001f600 </s></s>",
         "<s>[INST] user [/INST] hi </s>", " [/INST] ", "<</s>", "[/INST]</s>[INST]"]


def test_chat_round_trip_and_mask(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for c in range(30):
        turns = []
        for t in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "system", "we[/INST]ird\n", None])
            text = None if rng.random() < 0.1 else "".join(rng.choices(NASTY, k=rng.randint(1, 3)))
            turns.append((role or "", text or ""))
            rows.append((c, t, role, text, 5))
        want[c] = turns
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")
    ex = chat.format_examples(df)
    back = {r["conv_id"]: r for r in chat.read_back(ex).collect()}
    n_ex = {r["conv_id"]: r["count"] for r in ex.groupBy("conv_id").count().collect()}
    for c, turns in want.items():
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == turns
        replies = [t for r, t in turns if r == "assistant"]
        assert back[c]["loss"] == "".join(replies)
        assert n_ex[c] == len(replies) + (turns[-1][0] != "assistant")
    # the context of an example is the prefix of the whole conversation
    whole = {r["conv_id"]: r["formatted"] for r in ex.where("last").collect()}
    assert all(whole[r["conv_id"]].startswith(r["formatted"]) for r in ex.collect())


def test_chat_edge_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat.digests(chat.read_back(chat.format_examples(spark.createDataFrame([], schema)))).count() == 0
    df = spark.createDataFrame([(None, 0, "user", "a"), (None, 0, "user", "a"), (1, None, "assistant", "x" * 100_000),
                                (1, 2, None, None)], schema)
    got = {r["conv_id"]: r for r in chat.digests(chat.read_back(chat.format_examples(df))).collect()}
    assert got[None]["n_turns"] == 2 and got[None]["loss_chars"] == 0
    assert got[1]["n_turns"] == 2 and got[1]["loss_chars"] == 100_000
    assert got[1]["turns_sha256"] == hashlib.sha256(("assistant\n" + "x" * 100_000 + "\n\n\n").encode()).hexdigest()


def _fp(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    f = fingerprint.fingerprints(df, ["i"], "t").select("i", fingerprint.fingerprint_struct().alias("fp"))
    return f


def test_fingerprint_is_a_multiset_sum(spark):
    a, b, c = "first line\n", "second, a bit longer\n", "third\n"
    f = _fp(spark, [a + b + c, c + a + b, a + b, c, a + b + c + c, None, "", " "])
    x = {r["i"]: r["fp"] for r in f.collect()}
    h = lambda s: (s["n_pieces"], s["check"], s["lanes"])
    assert h(x[0]) == h(x[1]) and h(x[0]) != h(x[4]) and h(x[5]) == h(x[6]) != h(x[7])
    j = f.where("i = 0").select(F.col("fp").alias("whole")).join(f.where("i = 3").select(F.col("fp").alias("part"))) \
        .join(f.where("i = 2").select(F.col("fp").alias("rest")))
    r = j.select(fingerprint.combine(F.col("whole"), F.col("part"), -1).alias("less"), "rest", "whole",
                 fingerprint.combine(F.col("rest"), F.col("part")).alias("more"),
                 fingerprint.likeness(F.col("whole"), F.col("whole")).alias("one")).first()
    assert r["less"] == r["rest"] and r["more"] == r["whole"] and r["one"] == 1.0


def test_fingerprint_pieces_keep_the_text(spark):
    texts = ["a b c d e f g h i j\nk", "  lead", "\n\n", "x" * 5000, "ein zwei \t drei\r\n vier " * 40]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", F.regexp_extract_all("t", F.lit(fingerprint.PIECE), F.lit(0)).alias("p")).collect()
    assert all("".join(r["p"]) == r["t"] for r in got)
    assert all(len(p.split()) <= fingerprint.WORDS and "\n" not in p[:-1] for r in got for p in r["p"])


def test_fingerprint_next_documents_with_sparse_ids(spark):
    rng = random.Random(3)
    ids = sorted({rng.choice([rng.randint(-3000, 3000), rng.randint(-10**12, 10**12)]) for _ in range(300)})
    docs = [(i, "".join(rng.choice("ab é\n") for _ in range(rng.randint(0, 40))), 1, 2) for i in ids]
    df = spark.createDataFrame(docs, "doc_id long, text string, b int, rk int")
    got = {r["doc_id"]: r for r in fingerprint.edit_fingerprints(df).collect()}
    order = sorted(docs, reverse=True)
    for (i, t, *_), (_, nxt, *_) in zip(order, order[1:] + order[:1]):
        k = len(t) // 3
        assert got[i]["edited_sha256"] == hashlib.sha256((t[:len(t) - k] + nxt[:k]).encode()).hexdigest()
        assert got[i]["n_chars"] == len(t) and 0 <= got[i]["near_edited"] <= 1


def test_fingerprint_edge_rows(spark):
    schema = "doc_id long, text string"
    assert fingerprint.edit_fingerprints(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(1, None), (1, None), (None, "x y z"), (2, ""), (None, None), (3, "same words here"),
                                (4, "same words here")], schema)
    got = fingerprint.edit_fingerprints(df).collect()
    assert len(got) == 7
    f = {r["doc_id"]: r["fingerprint"] for r in got if r["doc_id"] is not None}
    assert f[3] == f[4] and f[1] == f[2] != f[3]


HTML = "<p>" + "long enough to be de-duplicated " * 5


@pytest.fixture
def archive(spark):
    rows = [(5, "http://a/5", HTML), (3, "http://a/3", HTML), (9, None, HTML), (1, "http://b/\r\nx: y", "short"),
            (2, "http://b/2", "short"), (4, "http://b/4", None), (6, "http://b/6", ""), (None, "u", HTML), (7, "u7", "é\r\n\r\n" * 50),
            (2**60 + 1, "big", "big id"), (3, "http://a/3", HTML)]
    df = spark.createDataFrame(rows, "record_id long, url string, html string")
    body = F.coalesce("html", F.lit(""))
    df = df.withColumn("digest", F.sha2(body, 256)).withColumn("payload_bytes", F.octet_length(body).cast("long"))
    folder = scratch_path(spark, "warc")
    return rows, folder, cut_lineage(warc.write_archive(warc.record_roles(df), folder, max_file_bytes=600))


def test_warc_round_trip(spark, archive):
    rows, folder, index = archive
    got = warc.read_records(index, folder, 3).collect()
    assert len(got) == len(rows)
    by = {(r["record_id"], r["url"]): r for r in got}
    for i, url, html in rows:
        r, body = by[(i, url)], (html or "").encode()
        assert r["payload_bytes"] == len(body) and r["digest"] == hashlib.sha256(body).hexdigest()
        if html == HTML and i != 3:
            assert (r["record_type"], r["refers_to"], r["payload"]) == ("revisit", 3, None)
        else:
            assert (r["record_type"], r["refers_to"], bytes(r["payload"])) == ("response", None, body)


def test_warc_selection_reads_ranges(spark, archive):
    _, folder, index = archive
    got = warc.read_records(index.where("url LIKE 'http://b/%'"), folder, 2).collect()
    assert sorted(r["record_id"] for r in got) == [1, 2, 4, 6]


def test_warc_coalesced_ranges():
    assert warc.coalesce_ranges([0, 10, 25, 1000], [10, 10, 5, 5], gap=5, span=1 << 20) == [(0, 30, 0, 3), (1000, 1005, 3, 4)]
    assert warc.coalesce_ranges([0, 10, 20], [10, 10, 10], gap=0, span=20) == [(0, 20, 0, 2), (20, 30, 2, 3)]
    assert warc.coalesce_ranges([], [], 1, 1) == []


def test_warc_empty_table(spark):
    df = spark.createDataFrame([], "record_id long, url string, html string, digest string, payload_bytes long")
    folder = scratch_path(spark, "warc")
    index = cut_lineage(warc.write_archive(warc.record_roles(df), folder))
    assert warc.read_records(index, folder, 2).count() == 0
