"""From raw documents to token files: five stages, each an operator of corrobora.llm on all its predecessor kept."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from corrobora.llm import decontaminate, mixing, quality, simhash, tokens
from corrobora.llm.common import crc_mod, keep, table
from corrobora.llm.queries import tokenizer_path


def _held_out(docs: DataFrame) -> Column:
    return crc_mod(docs["doc_id"], 4) == 2


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), _held_out(docs))
    return quality.scored(docs, model, carry=True)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents enter as often as their rates say."""
    return mixing.mixed(docs, mixing.domain_labels(table(spark, sf_dir, "labels")))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in token files, as read back: doc_id, start, n_tokens, ids_crc32."""
    return tokens.encoded(docs, tokenizer_path())


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each), ("decontamination", without_benchmark),
          ("mixing", mixed), ("token_output", token_files)]

#: classifiers, components, tilings and codes have no SQL form; tests/llm holds each stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
