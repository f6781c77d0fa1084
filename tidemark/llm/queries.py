"""Queries of this subpackage, for __spark_entry__.py."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import crc_mod, new_path, read_table
from tidemark.llm.decontaminate import contaminated
from tidemark.llm.embedding import embedding_groups
from tidemark.llm.language_id import language_id, learn_languages
from tidemark.llm.licenses import license_labels, license_spans
from tidemark.llm.lm import brown_scores
from tidemark.llm.mixing import mix_rates
from tidemark.llm.simhash import simhash_groups
from tidemark.llm.suffix_dedup import remove_repeats
from tidemark.llm.token_counts import token_counts
from tidemark.llm.token_output import read_tokens, write_tokens


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = read_table(spark, sf_dir, "documents").select("doc_id", "text"), new_path(spark, "tokens")
    write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_tokens(spark, path, digest=True)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    net = learn_languages(docs.select("doc_id", "text", "lang"))
    rows = docs.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "text")
    return language_id(rows, net)


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_scores(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Target shares of the domains' tokens; the total is such that the kept ones do not shrink.
MIX, MIX_KEEP = {"high": 0.90, "low": 0.08, "toxic": 0.02}, ("high", "low")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels")
    return mix_rates(docs, labels, MIX, MIX_KEEP).drop("same")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"), length=400, digest=True)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_labels(license_spans(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {"op1_token_output": op1_token_output, "op2_language_id": op2_language_id, "op3_simhash_dedup": op3_simhash_dedup, "op4_lm_scoring": op4_lm_scoring, "op5_source_mixing": op5_source_mixing, "op6_suffix_dedup": op6_suffix_dedup, "op7_token_counts": op7_token_counts, "op8_embedding_dedup": op8_embedding_dedup, "op9_decontamination": op9_decontamination, "op10_license_scan": op10_license_scan}
SQL: dict[str, str] = {}
