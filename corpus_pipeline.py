"""From raw documents to packed training sequences, one operator of inkfall.llm a stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from inkfall.llm import exact_dedup, langid, mixing, packing, queries, simhash
from inkfall.llm.common import spare_name, written

#: Consecutive documents of the mixture that are packed together.
WINDOW_DOCS = 4096


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language that the labels teach go."""
    return langid.keep_identified(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the one with the smallest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a similarity of 0.8 over five-word shingles, the smallest doc_id stays."""
    return simhash.drop_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, stored interleaved by the target weights of the sources that have some left, without repeats."""
    return mixing.mix(docs, queries.MIX_WEIGHTS, other=queries.MIX_OTHER, block_docs=queries.MIX_BLOCK, whole=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 4096 tokens, which follow the mixture window by window."""
    position = spare_name(docs, "_position")
    return packing.pack_in_order(mixing.in_order(docs, position), public_tokenizers.path("word_bpe_49k.json"), position, WINDOW_DOCS, capacity=4096, end_id=1)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("mixing", mixture),
    ("best_fit_packing", packed),
]

#: Language models, fingerprints and tokenizers are not SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
