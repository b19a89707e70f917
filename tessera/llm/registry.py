"""The opN_ queries and the pipeline, with SQL where DuckDB can express the result."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, chat, filter_audit, html_extraction, ngram_join, oracles, packing, prefix_trie, quality, sharding, substring_dedup, toxicity, vector_dedup, vector_search
from tessera.llm.common import table

def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeat_digests(table(spark, sf_dir, "documents"))


def op2_prefix_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", oracles.PROBE), (-1, 1, "assistant", oracles.PROBE)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.prefix_target_examples(turns.unionByName(probe)))


def op3_dom_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op4_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = quality.described(table(spark, sf_dir, "documents"), keep_text=False)
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op5_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.search(table(spark, sf_dir, "embeddings"))


def op6_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.vector_links(table(spark, sf_dir, "embeddings"))


def op8_vertical_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicate_groups(table(spark, sf_dir, "documents"), words=3, num=9, den=10)


def op9_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_along_curve(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, json_path=public_tokenizers.path("byte_bpe_50k.json"))


def op10_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_splitters(table(spark, sf_dir, "documents"))


def op11_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_nodes(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    built = (op1_suffix_array, op2_prefix_target, op3_dom_boosting, op4_co_training, op5_kmeans_tree, op6_merge_replay, op7_metric_join, op8_vertical_join, op9_hilbert_packing, op10_sampled_splitters, op11_toxic_spans, op12_filter_audit, op13_prefix_trie, pipeline)
    return {f.__name__: f for f in built}


def oracle_sql() -> dict[str, str]:
    return {"op2_prefix_target": oracles.CHAT, "op7_metric_join": oracles.VECTOR_LINKS, "op8_vertical_join": oracles.NEAR_DUPLICATES, "op12_filter_audit": oracles.FILTER_AUDIT, "op13_prefix_trie": oracles.PREFIX_TRIE}
