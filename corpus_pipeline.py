"""Corpus pipeline: stages over ``documents``, each written and read again.

Every stage but the last returns the columns of ``documents``; the last returns
the token ids of each row of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tally.llm.mixing import mix_documents
from tally.llm.pii import redact
from tally.llm.quality_outliers import keep_good
from tally.llm.queries import vocabulary
from tally.llm.sentencepiece_backend import encode_decode
from tally.llm.simhash import keep_first
from tally.session import scratch_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints, the one with the smallest id."""
    return keep_first(docs, shingle=3, max_bits=2)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the names of its kinds."""
    return redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with the checks of both libraries' agreement and of the way back."""
    return encode_decode(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: SQL has neither the hash of the fingerprints nor the tokenizers; tests/llm
#: holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in order to ``documents``; each result is written as
    Parquet to the shared scratch folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_dir(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
