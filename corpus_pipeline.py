"""A corpus from raw documents to token ids, in five stages; part of the subpackage loomspark.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before has kept; ``run`` writes each stage's
rows to the shared folder, so a lost executor costs no more than one stage. Stages 1 to 4 return the columns of docs.

1. toxicity: documents that the classifier rejects, at the threshold of their language, go.
2. near_duplicates: of each group of linked texts, the document with the smallest doc_id stays.
3. substring_dedup: strings of 50 bytes that an earlier document has are cut out of later ones; n_chars follows the text.
4. decontamination: documents that hold a benchmark window go.
5. bpe: each text becomes token ids, with a digest of what they decode to.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import bpe, decontamination, jaccard_join, substring_dedup, toxicity
from loomspark.llm._runtime import written

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean_documents(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = substring_dedup.deduplicated(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean_documents(docs, _table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.token_rows(docs, TOKENIZER)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("bpe", tokenize),
]

#: No SQL trains a classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
