"""Findings of round 3 on the pipeline: what its stages shuffle and leave on disk, and what they ask of the driver."""

import os
import random
import tracemalloc

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm import brute

from tessera.llm import common, ngram_join, quality


def _shuffled(spark) -> int:
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def _texts(n: int, words: int) -> list[str]:
    rng = random.Random(6)
    return [" ".join(f"{rng.getrandbits(32):08x}" for _ in range(words)) for _ in range(n)]


@pytest.mark.parametrize("cells", [64, 1 << 25])
def test_hash_test_keeps_what_is_there(spark, monkeypatch, cells):
    monkeypatch.setattr(common, "MOST_CELLS", cells)
    rows = spark.range(3000).select(F.when(F.col("id") != 7, F.col("id")).alias("hash_word"), "id")
    keys = spark.range(0, 3000, 30).withColumnRenamed("id", "k")
    maybe = {r["id"] for r in common.hash_test(rows, [F.col("hash_word")], keys).collect()}
    rest = {r["id"] for r in common.hash_test(rows, [F.col("hash_word")], keys, "left_anti").collect()}
    assert set(range(0, 3000, 30)) <= maybe and not maybe & rest and len(maybe) + len(rest) == 3000
    assert len(maybe) < 600 if cells > 64 else True
    assert common.hash_test(rows, [F.col("hash_word")], keys.limit(0)).count() == 0


def test_texts_without_partner_are_not_shuffled(spark, tmp_path):
    texts = _texts(600, 300)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    # these texts are small enough to be broadcast
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = _shuffled(spark)
        corpus_pipeline.one_of_each_group(spark, spark.read.parquet(str(tmp_path / "in")), "").write.parquet(str(tmp_path / "out"))
        assert _shuffled(spark) - before < sum(map(len, texts))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 600


@pytest.mark.parametrize("cells", [64, 1 << 25])
def test_groups_with_few_and_many_cells(spark, monkeypatch, cells):
    monkeypatch.setattr(common, "MOST_CELLS", cells)
    texts = _texts(60, 80)
    near = [t[: -9 * (i % 4)] or t for i, t in enumerate(texts[:30])]
    corpus = list(enumerate([*texts, *near, *texts[:20], *texts[:5], "", None, "one"]))
    frame = spark.createDataFrame(corpus, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicate_groups(frame).collect()}
    assert got == brute.near_duplicates(corpus, 5, 4, 5)
    kept = {r["doc_id"] for r in corpus_pipeline.one_of_each_group(spark, frame.unionByName(spark.createDataFrame([(None, "x")], frame.schema)), "").collect()}
    assert kept == {None, *(d for d, (_, c) in got.items() if d == c)}


def test_first_stage_leaves_no_texts_behind(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    d = "/root/testdata/sf0.001"
    docs = common.table(spark, d, "documents")
    kept = corpus_pipeline.judge(spark, docs, d)
    assert not any("described" in names for _, names, _ in os.walk(tmp_path))
    model = quality.fit(docs, common.table(spark, d, "labels"))
    asked = quality.keep_good(quality.described(docs), model)
    assert kept.columns == docs.columns and kept.exceptAll(asked).isEmpty() and asked.exceptAll(kept).isEmpty()


def test_rows_to_fit_on_are_no_python_objects(spark):
    rows = spark.range(1200).select(
        "id", F.col("id").alias(quality.HASH),
        F.expr("struct(transform(sequence(0, 1999), i -> cast(i as smallint)) as at, transform(sequence(0, 1999), i -> cast(i + id as float)) as value)").alias(quality.VIEW),
    )
    tracemalloc.start()
    try:
        found = quality._one_each(rows, "id")
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 30e6  # the dense rows are 11 MB
    known, x = found
    assert x.shape == (1200, quality.CONTENT_DIM + quality.META_DIM) and not x[:, 2000:].any()
    assert (x[:, :2000] == np.arange(2000) + known["id"].to_numpy()[:, None]).all() and (known["text"] == known["id"]).all()


@pytest.mark.parametrize("late", [False, True])
def test_settled_links_are_not_joined_again(spark, monkeypatch, late):
    """late: all links are found in the last step."""
    texts = _texts(40, 80)
    near = [t[: -9 * (1 + i % 4)] for i, t in enumerate(texts[:20])]
    corpus = list(enumerate([*texts, *near, *near[:5]]))
    calls, joined, starred = [], ngram_join.connected_components, ngram_join._starred
    monkeypatch.setattr(ngram_join, "connected_components", lambda *a: calls.append(a) or joined(*a))
    monkeypatch.setattr(ngram_join, "_starred", lambda *a, **b: starred(*a, **b).limit(0) if late else starred(*a, **b))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicate_groups(spark.createDataFrame(corpus, "doc_id long, text string")).collect()}
    assert got == brute.near_duplicates(corpus, 5, 4, 5)
    assert len(calls) == 2 + late
