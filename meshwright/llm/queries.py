"""The queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshwright.llm import warc

    return warc.digest(warc.resolve(warc.captures_of(table(spark, sf_dir, "pages"))))


def op2_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from meshwright.llm import token_orc

    return token_orc.written(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshwright.llm import shard

    return shard.assign(table(spark, sf_dir, "documents"))


def op4_url_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshwright.llm import url_trie

    return url_trie.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op5_suffix_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshwright.llm import suffix_index

    return suffix_index.deduplicated(table(spark, sf_dir, "documents"))


def op6_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from meshwright.llm import unigram

    return unigram.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshwright.llm import secrets

    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op8_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshwright.llm import wumanber

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return wumanber.digest(wumanber.marked(docs, table(spark, sf_dir, "benchmark")))


def op9_line_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshwright.llm import line_clean

    return line_clean.quality(table(spark, sf_dir, "documents"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshwright.llm import minhash

    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=4)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_revisits": op1_revisits,
    "op2_token_orc": op2_token_orc,
    "op3_label_propagation": op3_label_propagation,
    "op4_url_trie": op4_url_trie,
    "op5_suffix_index": op5_suffix_index,
    "op6_unigram": op6_unigram,
    "op7_secret_scan": op7_secret_scan,
    "op8_wu_manber": op8_wu_manber,
    "op9_line_clean": op9_line_clean,
    "op10_minhash": op10_minhash,
    "pipeline": pipeline,
}
