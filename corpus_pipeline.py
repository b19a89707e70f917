"""From raw documents to packed training sequences: judge, de-duplicate, cut repeats, pack.

Each stage takes what its predecessor kept, written as Parquet and read again. All stages but the last return the columns of
documents; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ngram_join, packing, quality, substring_dedup
from tessera.llm.common import Tables, free_name, hash_test, stored, table


def judge(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    tables = Tables(spark)
    model = quality.fit(quality.described(docs, keep_text=False, store=tables.stored), table(spark, sf_dir, "labels"))
    tables.remove()
    # texts are read again rather than kept beside the views while the later stages run
    return quality.keep_good(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near-equal shingle sets (five words, similarity 0.8), the one with the smallest id."""
    groups = ngram_join.near_duplicate_groups(docs, words=5, num=4, den=5)
    name = free_name("gone", docs.columns)
    gone = groups.filter("doc_id != component_id").select(F.col("doc_id").alias(name))
    own = [F.col("doc_id").cast("long")]
    unsure = hash_test(docs, own, gone).join(gone, F.col("doc_id") == F.col(name), "left_anti")
    return hash_test(docs, own, gone, "left_anti").unionByName(unsure)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less the 50-byte strings of documents with smaller ids; n_chars follows the text."""
    return substring_dedup.remove_repeats(docs, 50).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens along the curve."""
    return packing.pack_along_curve(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, json_path=public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", judge), ("near_duplicates", one_of_each_group), ("repeats", without_repeats), ("packing", packed)]

#: No SQL: a trained model decides in the first stage. Tests hold each stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
