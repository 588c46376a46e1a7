"""A training corpus from `documents`: clean, deduplicated, mixed and encoded.

Each stage takes (session, docs, folder) and returns a DataFrame; `run` writes every stage as
Parquet on the shared storage and gives what it reads back to the next one. All stages but the last
return the columns of their input, whatever other columns there are and however these are named; rows
with repeated or null ids are rows of their own, and an empty table stays empty.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameweave.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from frameweave.plans.staging import small_batches, staging_root

#: Words in an n-gram, and the similarity in percent from which two documents are near copies.
SHINGLE, SIMILAR = 5, 80


def clean(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the model, learned from `labels` outside the held-out fifth, does not call toxic.

    A null text counts as empty. Without labels of both classes nothing is dropped.
    """
    small_batches(spark)
    return toxicity.keep_clean(docs, spark.read.parquet(f"{folder}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document per distinct text, that of the largest id; null and empty texts are one text."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id; documents without words stay."""
    small_batches(spark)
    return ngram_join.keep_one(docs, SHINGLE, SIMILAR, 100)


def mixed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as the mix takes them (0, 1 or 2 times); documents without words are not taken."""
    return mixing.repeat_mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, source, ids, n_tokens and the decoded text's SHA-256 of each mixed document."""
    small_batches(spark)
    return bpe.encode_and_check(docs.select("doc_id", "source", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", clean),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing", mixed),
    ("BPE", encoded),
]

#: The learned model and the tokenizer have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    root = f"{staging_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, folder).write.parquet(f"{root}/{number}")
        docs = spark.read.parquet(f"{root}/{number}")
    return docs
