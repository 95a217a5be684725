"""The corpus pipeline: documents pass five stages, each on all that the one before kept.

Quality rules, near duplicates and contamination take documents away; the secret scan replaces
secrets in the texts that stay; at last the texts become token ids.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from meshwright.llm import line_clean, minhash, secrets, unigram, wumanber
from meshwright.llm.common import Scratch, settled

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: A file on the driver; executors get the model's tables by broadcast.
TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules go; of the others the failed lines go."""
    return line_clean.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the least id: shingles of five words, similarity 0.8."""
    return minhash.deduplicate(docs, size=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages hold a twentieth of the words or more go."""
    return wumanber.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay."""
    return secrets.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the text."""
    return unigram.encode(docs, TOKENIZER)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("tokens", tokens),
]
#: SQL cannot express the near-duplicate and tokenizing stages; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again by the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark, "pipeline") as scratch:
        for k, (name, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if k < len(STAGES) - 1:
                docs = scratch.table(docs, f"{k}-{name}")
                if k:
                    scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
        return settled(docs)
