"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.llm import chat, collocations, fingerprint, jaccard, langid, mixing, neardup, pitmanyor, quality, spm, toxicity, warc, whitening
from quarry.llm.batches import arrow_batches
from quarry.llm.labelled import fold
from quarry.session import cut_lineage, scratch_path, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


PROBE_ID, PROBE_TEXT = -7, "</s>[INST] ok [/INST]"


@register("op5_chat_format", r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
lens AS (
  SELECT *, 24 + length(role) + length(text)
      + len(regexp_extract_all(role, '</?s>|\[/?INST\]|<</?SYS>>'))
      + len(regexp_extract_all(text, '</?s>|\[/?INST\]|<</?SYS>>')) AS turn_chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM rows_),
sums AS (SELECT *, sum(turn_chars) OVER (PARTITION BY conv_id ORDER BY rn) AS upto FROM lens)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' OR rn = n THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM sums GROUP BY conv_id""")
def op5_chat_format(spark, sf_dir):
    convs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text"))
    return chat.digests(chat.read_back(chat.format_examples(convs.unionByName(probe))))


@register("op1_warc", """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
                  sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1 HAVING count(*) > 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN f.first_id IS NOT NULL AND p.page_id IS DISTINCT FROM f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id IS DISTINCT FROM f.first_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)""")
def op1_warc(spark, sf_dir):
    html = F.coalesce("html", F.lit(""))
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("long").alias("record_id"), "url", "html", F.sha2(html, 256).alias("digest"),
        F.octet_length(html).cast("long").alias("payload_bytes"))
    folder = scratch_path(spark, "warc")
    with arrow_batches(spark, 500):
        index = cut_lineage(warc.write_archive(warc.record_roles(pages), folder))
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return warc.read_records(index, folder, parts, with_payload=False).select(
        F.col("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"),
        "record_type", "refers_to")


@register("op4_fingerprint", r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, coalesce(text, '') AS t0,
    row_number() OVER (ORDER BY doc_id DESC NULLS LAST, coalesce(text, '')) AS rk FROM documents),
nx AS (SELECT a.*, b.rk AS nrk, substr(a.text, 1, (a.n - a.n // 3)::BIGINT) || substr(b.text, 1, (a.n // 3)::BIGINT) AS edited
       FROM d a JOIN d b ON b.rk = CASE WHEN a.rk = (SELECT max(rk) FROM d) THEN 1 ELSE a.rk + 1 END),
v AS (SELECT rk, 0 AS kind, text AS t FROM nx UNION ALL SELECT rk, 1, edited FROM nx),
pieces AS (SELECT rk, kind, sha256(p) AS h FROM (
    SELECT rk, kind, unnest(regexp_extract_all(t, '(?:[^ \t\n\r\f\x0B]+[ \t\r\f\x0B]*){1,8}\n?|[ \t\r\f\x0B]+\n?|\n')) AS p FROM v)),
words AS (SELECT rk, kind, i, ('0x' || substr(h, (8 * i + 1)::BIGINT, 8))::BIGINT AS w FROM pieces, range(8) r(i)),
checks AS (SELECT rk, kind, i, sum(w) % 4294967296 AS s FROM words GROUP BY ALL),
lanes0 AS (SELECT rk, kind, i, k, (2 * sum((w >> k) & 1) - count(*)) AS s
           FROM (SELECT * FROM words WHERE i < 4), range(32) r2(k) GROUP BY ALL),
lanes AS (SELECT rk, kind, i * 32 + k AS lane, CASE WHEN ((s % 65536) + 65536) % 65536 >= 32768
            THEN ((s % 65536) + 65536) % 65536 - 65536 ELSE ((s % 65536) + 65536) % 65536 END::BIGINT AS x FROM lanes0),
n AS (SELECT v.rk, v.kind, coalesce(c, 0) AS c FROM v LEFT JOIN (SELECT rk, kind, count(*) AS c FROM pieces GROUP BY ALL) USING (rk, kind)),
fp AS (SELECT n.rk, n.kind, n.c,
    coalesce(ch.x, repeat('0', 64)) || coalesce(la.x, repeat('0', 512)) AS f, coalesce(la.v, list_value()) AS v, coalesce(la.nn, 0) AS nn
  FROM n LEFT JOIN (SELECT rk, kind, string_agg(lpad(to_hex(s::BIGINT), 8, '0'), '' ORDER BY i) AS x FROM checks GROUP BY ALL) ch USING (rk, kind)
  LEFT JOIN (SELECT rk, kind, string_agg(lpad(to_hex(((x + 65536) % 65536)::BIGINT), 4, '0'), '' ORDER BY lane) AS x,
      list(x ORDER BY lane) AS v, sum(x * x) AS nn FROM lanes GROUP BY ALL) la USING (rk, kind))
SELECT nx.doc_id, nx.n::BIGINT AS n_chars, sha256(nx.edited) AS edited_sha256, lower(a.f) AS fingerprint, lower(e.f) AS edited_fingerprint,
  CASE WHEN a.c = e.c AND a.f = e.f THEN 1.0 WHEN a.nn * e.nn = 0 THEN 0.0 ELSE
    round(least(1.0, greatest(0.0, list_dot_product(a.v::DOUBLE[], e.v::DOUBLE[]) / sqrt(a.nn::DOUBLE * e.nn::DOUBLE))), 6) END::DOUBLE AS near_edited,
  CASE WHEN a.c = x.c AND a.f = x.f THEN 1.0 WHEN a.nn * x.nn = 0 THEN 0.0 ELSE
    round(least(1.0, greatest(0.0, list_dot_product(a.v::DOUBLE[], x.v::DOUBLE[]) / sqrt(a.nn::DOUBLE * x.nn::DOUBLE))), 6) END::DOUBLE AS near_next
FROM nx JOIN fp a ON a.rk = nx.rk AND a.kind = 0 JOIN fp e ON e.rk = nx.rk AND e.kind = 1 JOIN fp x ON x.rk = nx.nrk AND x.kind = 0""")
def op4_fingerprint(spark, sf_dir):
    return fingerprint.edit_fingerprints(table(spark, sf_dir, "documents"))


@register("op7_mixing", r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '')), 1, 9))::BIGINT AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS z, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT]::DOUBLE AS w
      FROM d GROUP BY source),
o AS (SELECT *, 3 * z AS cap, row_number() OVER (ORDER BY 3 * z / w, source NULLS LAST) AS k FROM s),
c AS (SELECT *, (sum(z) OVER () - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
f AS (SELECT min(k) AS k0, arg_min(level, k) AS level FROM c WHERE level * w <= cap),
t AS (SELECT c.source, c.z, CASE WHEN c.k < f.k0 THEN c.cap::DOUBLE ELSE f.level * c.w END AS target FROM c, f),
q AS (SELECT *, CASE WHEN z > 0 THEN floor(target + 0.5)::BIGINT // z ELSE 0 END AS passes,
        CASE WHEN z > 0 THEN floor(target + 0.5)::BIGINT % z ELSE 0 END AS rest FROM t),
g AS (SELECT source, u, sum(size)::BIGINT AS gs FROM d WHERE size > 0 GROUP BY ALL),
cum AS (SELECT *, sum(gs) OVER (PARTITION BY source ORDER BY u) AS upto FROM g),
lim AS (SELECT cum.source, min(u) AS lim, arg_min(2 * rest > 2 * upto - gs, u) AS take_at
        FROM cum JOIN q ON cum.source IS NOT DISTINCT FROM q.source WHERE upto > rest GROUP BY 1)
SELECT d.doc_id, d.size, q.z AS source_size, q.target,
  (d.size * (q.passes + CASE WHEN d.u < lim.lim OR (d.u = lim.lim AND take_at) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN lim ON d.source IS NOT DISTINCT FROM lim.source""")
def op7_mixing(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    sized = cut_lineage(d.select("doc_id", mixing.seeded_hash(F.col("doc_id"), 7).alias("u"),
                                 mixing.word_count("text").alias("size"), F.array("source").alias("sources")))
    return mixing.apply_mix(sized, mixing.plan_mix(sized)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


@register("op8_quality")
def op8_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    score = quality.scorer(model)
    return docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), score("text").alias("score")) \
        .select("*", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@register("op9_toxicity")
def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    score = toxicity.scorer(model)
    return docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), score("text").alias("s")).select(
        "doc_id", "held_out", "s.score", (F.col("s.score") >= 0.7).cast("int").alias("predicted"), "s.evidence")


@register("op6_langid")
def op6_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    crf = langid.fit(docs, fold("doc_id", 5) != 0)
    score = langid.scorer(crf)
    return docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), score("text").alias("s")) \
        .select("doc_id", "held_out", "s.lang_pred", "s.score")


SP_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@register("op2_sentencepiece")
def op2_sentencepiece(spark, sf_dir):
    return spm.encode_table(table(spark, sf_dir, "documents").select("doc_id", "text"), SP_MODEL, ["doc_id"])


@register("op3_neardup", """
WITH RECURSIVE v AS (
  SELECT vec_id, label, row_number() OVER () AS r, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(node, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.node),
c AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT m.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, coalesce(c.component_id, m.vec_id) AS component_id,
  coalesce(m.vec_id = coalesce(c.component_id, m.vec_id), false) AS kept
FROM embeddings m LEFT JOIN c ON c.node = m.vec_id LEFT JOIN n ON n.a = m.vec_id""")
def op3_neardup(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


@register("op10_jaccard", r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT r, s FROM (
  SELECT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w)),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS i FROM g a JOIN g b ON a.s = b.s AND a.r < b.r GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(node, root) AS (SELECT r, r FROM w UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.node),
c AS (SELECT node, min(x.doc_id) AS component_id FROM reach JOIN w x ON x.r = root GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (r) JOIN c ON c.node = w.r""")
def op10_jaccard(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


@register("op11_whitening")
def op11_whitening(spark, sf_dir):
    return whitening.long_form(whitening.whiten(table(spark, sf_dir, "embeddings")))


@register("op13_collocations", r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d,
    string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
w AS (SELECT lang, regexp_extract_all(unnest(ps), '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, m, phrase, count(*)::HUGEINT AS f FROM (
  SELECT lang, m, unnest(list_transform(range(1, (len(w) - m + 2)::BIGINT), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
  FROM w, range(1, 4) r(m) WHERE len(w) >= m) GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM g WHERE m >= 2 AND f >= 10),
cut AS (SELECT lang, m, phrase, f, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:m], ' ') AS rp
        FROM c, range(1, 3) q(k) WHERE k < m),
s AS (SELECT cut.*, a.f AS l, b.f AS r, (1000000 * cut.f * cut.f) // (a.f * b.f) AS score
      FROM cut JOIN g a ON a.lang = cut.lang AND a.phrase = lp JOIN g b ON b.lang = cut.lang AND b.phrase = rp),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, part, max(f) AS top FROM (SELECT lang, f, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS part FROM c WHERE m = 3) GROUP BY ALL),
o AS (SELECT b.* FROM b LEFT JOIN i ON i.lang = b.lang AND i.part = b.phrase AND b.m = 2 WHERE top IS NULL OR 100 * top < 50 * f)
SELECT o.lang, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, f DESC, phrase)::BIGINT AS rank, phrase,
  f::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n.n::BIGINT AS n, score::BIGINT AS score
FROM o JOIN n ON n.lang = o.lang QUALIFY rank <= 2000""")
def op13_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


@register("op12_pitman_yor")
def op12_pitman_yor(spark, sf_dir):
    return pitmanyor.score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), fold("doc_id", 7) != 2)
