"""The corpus pipeline: language, quality, exact copies, near copies, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowmill.llm import exact_dedup, langid, minhash, packing, quality
from sparrowmill.llm.common import crc_of_id, materialize, table

TOKENIZER = "word_bpe_49k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; learns from those with crc32(doc_id) mod 4 <> 2."""
    model = langid.train(docs.where(F.pmod(crc_of_id(), F.lit(4)) != 2))
    return langid.identified(docs, model)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; learns from labels with crc32(doc_id) mod 5 <> 0."""
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").where(F.pmod(crc_of_id(), F.lit(5)) != 0)
    net = quality.train(docs.select("doc_id", "text"), labels)
    return quality.accepted(docs, net)


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.without_near_duplicates(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language", language),
    ("quality", good_quality),
    ("exact_dedup", without_exact_copies),
    ("near_dedup", without_near_copies),
    ("packing", packed),
]

#: Trained models and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
