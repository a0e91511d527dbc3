"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import bpe, collocations, conversations, decontamination, jaccard_join, lm_quality, repetition, resampling, sentencepiece_bpe, substring_dedup, token_files, toxicity, url_lists
from .oracles import ORACLES as ORACLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.coverage(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = token_files.write_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_files(manifest)


def op10_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = url_lists.verdicts(url_lists.dated(pages), url_lists.revisions(pages))
    return found.withColumn("fetched_at", found.fetched_at.cast("string")).withColumn("since", found.since.cast("string"))


def op4_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.rendered(table(spark, sf_dir, "conversations"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removals(table(spark, sf_dir, "documents"))


def op8_lm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrases(table(spark, sf_dir, "documents"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentencepiece_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": corpus_pipeline.run,
    "op1_repetition_coverage": op1_repetition_coverage,
    "op9_token_files": op9_token_files,
    "op10_bpe_roundtrip": op10_bpe_roundtrip,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op2_url_lists": op2_url_lists,
    "op4_chat_collapse": op4_chat_collapse,
    "op5_toxicity": op5_toxicity,
    "op3_jaccard_join": op3_jaccard_join,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_lm_quality": op8_lm_quality,
    "op11_collocations": op11_collocations,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_importance_resampling": op13_importance_resampling,
}
