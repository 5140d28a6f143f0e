"""The corpus pipeline: raw documents to token ids of a clean, deduplicated, mixed corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet to the shared
checkpoint folder and read again as the next stage's documents.  All stages but the last return the
columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from supplyscope.llm import bpe, mixing, neardup, quality
from supplyscope.llm.textops import stored


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier selects."""
    return quality.select_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more)."""
    return neardup.deduplicate(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's weight asks, once at least."""
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the text."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("quality", classify), ("near_duplicates", deduplicate), ("mixing", mix), ("tokens", tokenize)]

#: A classifier, hashed permutations and a BPE can't be told in SQL.  Tests hold run() against the stages one by one, and
#: their operators against brute force, the tokenizer library or held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": (run, ORACLE_SQL)}
