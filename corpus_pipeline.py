"""The corpus pipeline: toxicity, near copies, benchmark passages, mix, shards.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one
before it kept.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gnomon.llm import decontamination, mixing, near_dedup, sharding, toxicity
from gnomon.llm.common import fresh, table
from gnomon.scratch import discard, mark, materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go."""
    judge = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    name = fresh("score", docs.columns)
    return toxicity.score(docs, judge, score_col=name).where(F.col(name) < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one document stays, the one with the smallest id.

    Rows that repeat it, id and text, are copies of it too, so one row stays.
    """
    found = near_dedup.near_duplicates(docs)
    keep = found.where("representative").select(F.col("row_id").alias("__node"), F.col("key").alias("__key")).distinct()
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumn("__node", near_dedup.node_id("doc_id", text)).withColumn("__key", F.unhex(F.md5(text)))
    return rows.join(keep, ["__node", "__key"], "left_semi").dropDuplicates(["__node", "__key"]).select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a benchmark's passage go."""
    packed = docs.select(F.struct(*docs.columns).alias("__row"), F.col("text"))
    return decontamination.scan(packed, table(spark, sf_dir, "benchmark")).where("n_hit = 0").select("__row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mix(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each row of the mix goes."""
    return sharding.shard_documents(docs, sharding.topology(sharding.SHARDS))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: No SQL: language models and signatures are not SQL's.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what lies between them is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    began = mark()
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
            discard(began, keep=(f"stage-{name}",))
    return docs
