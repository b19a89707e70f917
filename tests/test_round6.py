"""Findings of round 4: what the page index and the answers from it leave on disk."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieval
from tessera.streaming import answers, page_index

PAGE = "doc_id long, text string, fuente string"


def _shuffled(spark) -> int:
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def _stored(path) -> int:
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


@pytest.fixture
def no_broadcast(spark):
    """These texts are small enough to be broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_texts_and_pairs_are_not_shuffled(spark, tmp_path, no_broadcast):
    rng = random.Random(6)
    texts = [" ".join(f"{rng.getrandbits(32):08x}" for _ in range(300)) for _ in range(600)]
    size = sum(map(len, texts))
    spark.createDataFrame([(i, t, "f") for i, t in enumerate(texts)], PAGE).write.parquet(str(tmp_path / "in"))
    before, index = _shuffled(spark), str(tmp_path / "index")
    page_index.append(spark.read.parquet(str(tmp_path / "in")), index, 0)
    written = _shuffled(spark) - before
    print(size, written, _stored(index))
    assert written < 0.1 * size and _stored(index) < 2 * size
    asked = spark.createDataFrame([(i, texts[7 * i][:90], None) for i in range(20)], "qid long, question string, stage int")
    before = _shuffled(spark)
    got = {r["qid"]: r["resultado"] for r in answers.answer_from(asked, index).collect()}
    print(_shuffled(spark) - before)
    assert _shuffled(spark) - before < 0.5 * size
    assert got == {i: texts[7 * i] for i in range(20)}


@pytest.mark.parametrize("shipped", [0, 1 << 19])
def test_postings_are_those_of_the_page_that_is_kept(spark, tmp_path, monkeypatch, shipped):
    monkeypatch.setattr(page_index, "IDS_SHIPPED", shipped)
    rng, path = random.Random(7), str(tmp_path)
    rows = [(i % 40, " ".join(rng.choices("abcdefghij", k=rng.choice([0, 1, 2, 9, 200]))), f"{i}") for i in range(130)]
    rows += [(50, None, "n"), (51, "", "e"), (52, "one", "o"), (53, "Ärger über Öl ärger Über", "u"), (None, "a b", "x"), *[(54, "x y", "s")] * 3]
    before = spark.conf.get(page_index.WRITERS)
    page_index.append(spark.createDataFrame(rows, PAGE).repartition(7), path, 3)
    assert spark.conf.get(page_index.WRITERS) == before
    kept = [tuple(r) for r in page_index.pages_of(spark, path).select("doc_id", "text", "fuente").collect()]
    assert sorted(r[0] for r in kept) == [*range(40), *range(50, 55)] and set(kept) <= set(rows)
    want = {(i, len(retrieval.pairs_of(t)), p, 3) for i, t, _ in kept for p in retrieval.pairs_of(t)}
    pairs = spark.createDataFrame([(p,) for *_, p, _ in want], "pair string")
    found = page_index.postings_for(pairs, path)
    got = [tuple(r) for r in found.select("fid", "nf", "pair", "batch").collect()]
    assert len(got) == len(want) and set(got) == want
    assert found.filter(F.col("bucket") != page_index._bucket("pair")).count() == 0


@pytest.mark.parametrize("shipped", [0, 1 << 19])
def test_answers_by_few_and_many_hits(spark, tmp_path, monkeypatch, no_broadcast, shipped):
    monkeypatch.setattr(answers, "HITS_SHIPPED", shipped)
    monkeypatch.setattr(retrieval, "PAIRS_SHIPPED", shipped)
    index = str(tmp_path)
    page_index.append(spark.createDataFrame([(1, "one two three four", "f"), (2, "five six seven eight", "f"), (3, "one two", "f")], PAGE), index, 0)
    page_index.append(spark.createDataFrame([(1, "five six seven nine ten", "g")], PAGE), index, 1)
    asked = spark.createDataFrame([(1, "one two three", 1), (2, "five six seven", None), (3, "seven nine ten", 0), (4, "no such words", None), (5, "", None)], "qid long, question string, stage int")
    got = {r["qid"]: (r["encontrada"], r["resultado"], r["puntaje"]) for r in answers.answer_from(asked, index).collect()}
    assert {q: got[q][0] for q in got} == {1: True, 2: True, 3: True, 4: False, 5: False}
    assert {q: got[q][1:] for q in (1, 2, 3)} == {1: ("one two", 0.5), 2: ("five six seven eight", 1.0), 3: ("five six seven nine ten", 1.0)}
