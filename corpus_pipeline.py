"""Training-corpus pipeline over ``documents``: five stages, each a dealt operator.

1. toxicity          documents predicted toxic go
2. quality           documents predicted to be of low quality go
3. near_duplicates   of each group of near copies one document stays
4. mixing            documents are repeated or left out to meet the source targets
5. encode            token ids of every remaining row

A stage is ``f(spark, docs, sf_dir) -> DataFrame``; what it returns is written as
Parquet and read back as the next one's ``docs``.  All but the last return the
columns of ``documents``.  Defined results: null and empty texts score the
classifiers' base rates (toxicity: kept; quality: the score of an empty text
decides), are never near copies, and have no words to mix, so that stage 4
leaves them out; rows repeating an id are judged alike, and stage 3 keeps one
of equal rows; empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import jaccard, mixing, quality, spm, toxicity
from quarry.llm.labelled import fold
from quarry.llm.queries import SP_MODEL
from quarry.session import cut_lineage, table

TOXIC_FROM, GOOD_FROM, MIX_SEED, BATCH_ROWS = 0.7, 0.3, 7, 500


def narrow_batches(spark: SparkSession) -> None:
    """At most ``BATCH_ROWS`` documents are exchanged with Python at once.  A stage is computed by whoever
    writes its result, so this session setting stays: it bounds memory and changes no result."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    spark.conf.set(name, str(BATCH_ROWS if now <= 0 else min(now, BATCH_ROWS)))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose calibrated toxicity is below ``TOXIC_FROM`` (learned without fold 1 of 3)."""
    narrow_batches(spark)
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    score = toxicity.scorer(model)
    return docs.withColumn("_s", score("text")).where(F.col("_s.score") < TOXIC_FROM).drop("_s")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose quality score is at least ``GOOD_FROM`` (learned without fold 0 of 5)."""
    narrow_batches(spark)
    model = quality.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    score = quality.scorer(model)
    return docs.withColumn("_s", score("text")).where(F.col("_s") >= GOOD_FROM).drop("_s")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies.  Of rows that repeat an id and text
    one stays; an id goes if all its rows are redundant.  Documents without a word and rows with null
    ids all stay."""
    narrow_batches(spark)
    groups = jaccard.jaccard_components(docs).where("n_shingles > 0 AND doc_id IS NOT NULL") \
        .groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count("*").alias("n"))
    groups = cut_lineage(groups.where("NOT stays OR n > 1"))
    left = docs.join(groups.where("NOT stays").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    repeated = groups.where("stays AND n > 1").select("doc_id")
    if not repeated.limit(1).count():
        return left
    w = Window.partitionBy("doc_id", "text").orderBy("text", *[c for c in docs.columns if c not in ("doc_id", "text")])
    some = left.join(repeated, "doc_id", "left_semi").withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    return left.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(some.select(*docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0 to 3 times)."""
    row = F.struct(*docs.columns).alias("row")
    rows = docs.select(row, mixing.seeded_hash(F.col("doc_id"), MIX_SEED).alias("u"),
                       mixing.word_count("text").alias("size"), F.array("source").alias("sources"))
    sized = cut_lineage(rows.drop("row"))
    return mixing.apply_mix(rows, mixing.plan_mix(sized)) \
        .select("row", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, lang, source, ids, n_tokens, round_trip)`` of every row."""
    narrow_batches(spark)
    return spm.encode_table(docs, SP_MODEL, ["doc_id", "lang", "source"])


STAGES = [("toxicity", drop_toxic), ("quality", drop_low_quality), ("near_duplicates", drop_near_duplicates),
          ("mixing", mix_sources), ("encode", encode)]

#: SQL cannot express nearest neighbours, boosted trees or piece encoding; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
