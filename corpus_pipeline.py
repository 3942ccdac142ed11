"""Corpus cleaning in five stages, each by one of the operators.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the result is written as Parquet to the
shared folder and read again. All but the last stage return the columns of `documents`, and keep every clean document.

1. toxicity: documents predicted toxic go; the classifier learns from `labels`.
2. near_dedup: of every class of equal or near-equal texts the document of least id stays.
3. decontamination: documents that hold a `benchmark` item go.
4. pii: personal data in texts are replaced, `n_chars` follows.
5. bpe: every text is encoded and decoded; ids and digests are added.

Empty and null texts pass every stage.
"""

from __future__ import annotations

import os
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from snapledger.llm import bagminhash, bpe, decontaminate, pii, toxicity  # noqa: E402
from snapledger.llm.common import folder, free_name  # noqa: E402


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    score, predicted = free_name(docs, "toxic_score"), free_name(docs, "toxic_predicted")
    rated = toxicity.scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), score, predicted)
    return rated.where(F.col(predicted) == 0).drop(score, predicted)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bagminhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sanitising(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitised(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kinds = ("ids", "n_tokens", "ids_sha256", "decoded_sha256")
    return bpe.encode(docs, bpe.tokenizer_path(), {free_name(docs, k): k for k in kinds})


STAGES = [("toxicity", keep_clean), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", sanitising), ("bpe", encoding)]
# The classifier, the signatures and the tokenizer have no SQL equivalent; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. Every stage's output is a table in the shared folder, so a lost executor repeats
    only its part of one stage."""
    base = f"{folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{base}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
