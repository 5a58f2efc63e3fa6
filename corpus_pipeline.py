"""Corpus pipeline: from raw documents to packed training sequences.

Each stage takes what the one before it kept; ``run`` writes every stage as a table in the
shared folder, so a lost executor costs a part of one stage.  All stages but the last
return the columns of ``documents``.

Defined cases: NULL and empty texts are scored like others, count as copies of each other,
have fingerprint zero and hold nothing to pack; rows with a NULL doc_id are scored and are
never dropped as copies; without labels of both kinds all texts score the share of toxic
ones; further columns, whatever their names, stay as they are; no documents give no rows.
"""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.llm.exact_dedup import drop_copies
from gridtide.llm.packing import packed
from gridtide.llm.pii import EXAMPLE_KEY, pseudonymise
from gridtide.llm.simhash import drop_near_copies
from gridtide.llm.token_counts import token_measure
from gridtide.llm.toxicity import drop_toxic
from gridtide.session import materialize

KEY = EXAMPLE_KEY
TOKENIZER = tokenizer_path("byte_bpe_50k.json")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, taught on the labelled ones, does not reject."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of fingerprints (three-word shingles, at most
    two bits apart) connect."""
    return drop_near_copies(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms; the character count follows the text."""
    out = pseudonymise(docs, KEY)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text").cast("bigint")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece, a span of token ids, of every document in a sequence."""
    return packed(docs, F.col("text"), measure=token_measure(spark, TOKENIZER))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("pii", pii),
    ("packing", packing),
]
#: Compression, fingerprints and the packing search have no SQL twin; tests compare the
#: stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
