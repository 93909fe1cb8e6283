"""A corpus pipeline of five of the operators: each stage works on what its predecessor kept.

Toxic documents go, then those that no learned language accepts, then all but one of each group of near-duplicates; what is left
is mixed to target weights along a curriculum, a row per copy that is read, and encoded to the ids of a byte-level BPE vocabulary.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import langid, mixing, similar, toxicity
from palimpsest.llm._common import shared_dir, small_batches, table
from palimpsest.llm.byte_bpe import encode_documents


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trains on labelled documents outside the held-out fold, and drops documents predicted toxic."""
    small_batches(spark)
    return toxicity.drop_toxic(docs, toxicity.train(toxicity.training_rows(docs, table(spark, sf_dir, "labels"))))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trains on the stage's documents outside the held-out fold, and drops documents without letters or of no learned language."""
    small_batches(spark)
    return langid.drop_rejected(docs, langid.train(langid.training_rows(docs)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops all but one of texts whose SimHashes are within 4 bits, and of what is left, of texts with five-word Jaccard likeness 0.8 or more."""
    small_batches(spark)
    return similar.keep_one_like(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy of a document that the mix takes, in ranges of training position."""
    return mixing.curriculum(mixing.assign(docs)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, and whether the ids decode to the text."""
    small_batches(spark)
    out = encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    exact = F.sha2("decoded", 256) == F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return out.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), exact.alias("exact"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("near_dedup", drop_near_duplicates),
    ("mix", mix),
    ("byte_bpe", encode),
]

#: SQL can't express trained models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}_{name}")
            docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
