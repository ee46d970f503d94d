"""Registered queries of this subpackage, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.session import scratch_dir

TOKEN_LIMIT = 4096
END_ID = 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_token_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tally.llm.token_prefix import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), TOKEN_LIMIT)


def op9_sentencepiece_backend(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tally.llm.sentencepiece_backend import encode_decode

    return encode_decode(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), with_ids=False)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tally.llm.token_files import read_tokens, write_tokens

    path = scratch_dir(spark, "token-files")
    write_tokens(_table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"), END_ID)
    return read_tokens(spark, path)


def op3_simhash_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tally.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, max_bits=2) \
        .select("doc_id", "fingerprint", "component_id")


def op4_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tally.llm.license_rules import license_scan

    return license_scan(_table(spark, sf_dir, "documents"), with_detections=False).drop("detections")


def op5_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tally.llm.quality_outliers import quality

    return quality(_table(spark, sf_dir, "documents")).drop("distance")


def op7_golden_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tally.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents")).drop("source", "text_hash")


def op1_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tally.llm.pii import find_personal_data

    return find_personal_data(_table(spark, sf_dir, "documents")).drop("span_list")


def op10_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tally.llm.language_id import identify

    return identify(_table(spark, sf_dir, "documents"))


def op2_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tally.llm.learned_partitions import nearest_neighbours

    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op11_fm_index_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tally.llm.spelling import variant_groups

    return variant_groups(_table(spark, sf_dir, "documents"), least=6, times=5, factor=5, every=199)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tally.llm.periodic_runs import find_runs, planted, run_digests

    return run_digests(find_runs(_table(spark, sf_dir, "documents"), shortest=12, repeat=planted))


def op13_clause_grammar_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tally.llm.toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7)
