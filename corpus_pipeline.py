"""Corpus pipeline: toxicity filter, exact deduplication, near-duplicate removal,
source mixing and packing, each stage on all rows its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
result as Parquet in the shared folder and rereads it as the next stage's input.
All but the last return the columns of documents.
"""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recoflow.llm import exact_dedup, mixing, packing, setjoin, toxicity
from recoflow.llm.common import Work
from recoflow.llm.queries import TOKENIZER, TOXIC_SCORE, held_out

#: Near duplicates of this pipeline: five-word shingles, similarity of 0.8 or more.
NEAR_WORDS, NEAR_NUM, NEAR_DEN = 5, 80, 100


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7; the model never sees held-out labels."""
    labels = spark.read.parquet(os.path.join(sf_dir, "labels.parquet"))
    model = toxicity.fit(spark, docs, labels.where(~held_out(F.col("doc_id"))))
    return toxicity.clean_rows(spark, docs, model, TOXIC_SCORE)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return exact_dedup.kept_rows(spark, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by near duplicates, the document with the smallest doc_id."""
    groups, _ = setjoin.link_groups(spark, docs, NEAR_WORDS, NEAR_NUM, NEAR_DEN)
    dropped = groups.where("id != component_id").select(F.col("id").alias("_dropped")).distinct()
    return docs.join(dropped.hint("merge"), docs["doc_id"] == dropped["_dropped"], "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 5, 2, 1: rows left out, taken, or taken up to three times."""
    return mixing.mixed_rows(spark, docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in sequences of 4096 tokens."""
    pieces, _ = packing.pack(spark, docs, public_tokenizers.path(TOKENIZER))
    return pieces.withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier has no SQL form: tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Work(spark, "pipeline")
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for k, (name, stage) in enumerate(STAGES):
        docs = work.keep(stage(spark, docs, sf_dir), name)
        if k:
            work.drop(STAGES[k - 1][0])
    return docs
