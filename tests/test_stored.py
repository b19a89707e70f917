"""Stored indexes, as-of joins, the packing fold and histograms against plain versions."""

import bisect
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluation, fragments, pages, retrieval, vector_index
from tessera.streaming import page_index

VEC = "fid long, fv array<float>, flabel int"


def vectors(n=300, dim=8, seed=4):
    rng = np.random.default_rng(seed)
    return [(i, rng.normal(size=dim).astype(np.float32).tolist(), [None, 0, 1, 2, 3, 7][i % 6]) for i in range(n)]


def plain(questions, rows, k):
    out = set()
    for q, qv, stage in questions:
        a = np.array(qv, float) / np.linalg.norm(qv)
        scored = sorted((-round(float(a @ (np.array(v, float) / np.linalg.norm(v))), 6), f) for f, v, s in rows if f != q and (not stage or s == stage))[:k]
        out |= {(q, f, -s, r) for r, (s, f) in enumerate(scored, 1)}
    return out


def found(df):
    return {(r["qid"], r["fid"], round(r["score"], 6), r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("block", [4096, 5])
def test_filtered_search_reads_the_stages_asked_for(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(vector_index, "QUESTION_BLOCK", block)
    monkeypatch.setattr(vector_index, "FRAGMENT_BLOCK", 17)
    rows = vectors()
    path = str(tmp_path / "stages")
    vector_index.write_by_stage(spark.createDataFrame(rows, VEC), path)
    asked = [(q, v, s) for q, v, s in rows[:40]]
    frame = spark.createDataFrame(asked, "qid long, qv array<float>, qlabel int")
    assert found(vector_index.nearest_in_stage(frame, path, 4)) == plain(asked, rows, 4)
    assert found(vector_index.nearest_in_stage(frame.limit(0), path, 4)) == set()

    def read(stages):
        out = vector_index.nearest_in_stage(frame.filter(F.col("qlabel").isin(*stages)), path, 4)
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "dynamicpruningexpression" in plan
        nodes, files = [out._jdf.queryExecution().executedPlan()], 0
        while nodes:
            node = nodes.pop()
            name = node.nodeName()
            if name.startswith("Scan parquet") and "fv" in node.simpleString(1000):
                files += node.metrics().apply("numFiles").value()
            kids = node.children()
            nodes += [kids.apply(i) for i in range(kids.size())]
            nodes += [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in name else []
        return files

    if block == 4096:
        assert 0 < read([1]) < read([1, 2, 3])


@pytest.mark.parametrize("block", [4096, 30])
def test_cells_hold_nearly_all_neighbours(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(vector_index, "QUESTION_BLOCK", block)
    rows = vectors(900, 16)
    # clustered, and a third of all rows alike
    rows = [(i, (np.array(v) + 4 * np.eye(16)[i % 16]).tolist() if i % 3 else [1.0] * 16, s) for i, v, s in rows]
    path = str(tmp_path / "cells")
    frame = spark.createDataFrame(rows, VEC)
    vector_index.write_cells(frame, path)
    about = spark.read.parquet(f"{path}/centres").collect()
    assert spark.read.parquet(f"{path}/rows").count() == 900 and len(about) > 30
    asked = [r for r in rows if r[0] % 3][:60]
    questions = spark.createDataFrame(asked, "qid long, qv array<float>, qlabel int")
    got, want = found(vector_index.search_cells(questions, path, 10)), plain([(q, v, None) for q, v, _ in asked], rows, 10)
    assert len({x[:2] for x in got} & {x[:2] for x in want}) >= 0.94 * len(want) and about[0]["probes"] <= 0.6 * len(about)
    # all cells: the exact answer
    exact = found(vector_index.search_cells(questions, path, 10, probes=len(about)))
    assert {(q, f, r) for q, f, _, r in exact} == {(q, f, r) for q, f, _, r in want}
    scores = {(q, f): s for q, f, s, _ in want}
    assert all(abs(s - scores[q, f]) < 2e-6 for q, f, s, _ in exact)  # rounded in another way


PAGE = "doc_id long, text string, etapa int"


def test_index_grows_and_replaces(spark, tmp_path):
    path = str(tmp_path / "index")
    page_index.create(spark, path, PAGE)
    asked = spark.createDataFrame([(1, "alpha beta gamma delta")], "qid long, text string")
    assert page_index.candidates(asked, path, 5).count() == 0
    page_index.append(spark.createDataFrame([(10, "alpha beta gamma delta", 1), (10, "alpha beta gamma delta", 1), (None, "alpha beta", 1)], PAGE), path, 0)
    page_index.append(spark.createDataFrame([(11, "alpha beta", None), (12, None, 2)], PAGE), path, 1)
    assert [(r["fid"], r["pair_score"]) for r in page_index.candidates(asked, path, 5).orderBy("rank").collect()] == [(10, 1.0), (11, 0.333333)]
    # a newer version of a page, and a batch that is written again
    for _ in range(2):
        page_index.append(spark.createDataFrame([(10, "gamma delta and other words", 1)], PAGE), path, 2)
    assert {(r["fid"], r["pair_score"], r["batch"]) for r in page_index.candidates(asked, path, 5).collect()} == {(10, 0.333333, 2), (11, 0.333333, 1)}
    pairs = retrieval.asked(asked, "qid")
    rows = page_index.postings_for(pairs, path)
    assert "PartitionFilters: [bucket" in rows._jdf.queryExecution().executedPlan().toString().replace("PartitionFilters: [isnotnull(bucket", "PartitionFilters: [bucket")
    assert len(rows.inputFiles()) >= 1
    read = {r[0] for r in rows.select(F.input_file_name()).distinct().collect()}
    assert len(read) < len(spark.read.parquet(f"{path}/postings").inputFiles())


def test_streamed_pages_are_found(spark, tmp_path):
    from tessera.streaming import answers

    path, source = str(tmp_path / "index"), str(tmp_path / "source")
    schema = "doc_id long, text string, fuente string, pagina_inicio int, seccion string, actividad string, herramienta string"
    page_index.create(spark, path, schema)
    spark.createDataFrame([(1, "one two three four", "f", 1, "s", "", "")], schema).write.parquet(source)
    stream = lambda: spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    page_index.follow(stream(), path, str(tmp_path / "offsets")).awaitTermination()
    asked = spark.createDataFrame([(7, "five six seven", None)], "qid long, question string, stage int")
    assert not answers.answer_from(asked, path).first()["encontrada"]
    spark.createDataFrame([(2, "five six seven eight", "f", 1, "s", "", "")], schema).write.mode("append").parquet(source)
    page_index.follow(stream(), path, str(tmp_path / "offsets")).awaitTermination()
    assert answers.answer_from(asked, path).first()["resultado"] == "five six seven eight"


def test_as_of_join_without_broadcast(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "b", "hot", "hot", "hot", None]), rng.choice([None, *range(50)])) for i in range(400)]
    entries = [(k, s, f"{k}{n}") for n, (k, s) in enumerate((rng.choice(["a", "hot", "none", None]), rng.choice([None, *range(0, 50, 3)])) for _ in range(120))]
    by = {}
    for k, s, name in entries:
        if k is not None and s is not None:
            by.setdefault(k, []).append((s, name))
    want = {}
    for i, k, at in rows:
        own = sorted(by.get(k, []))
        n = bisect.bisect_right(own, at, key=lambda x: x[0]) if at is not None else 0
        want[i] = own[n - 1] if n else None
    frame = spark.createDataFrame(rows, "i long, key string, at int")
    out = pages.as_of_keyed(frame, spark.createDataFrame(entries, "key string, start int, name string"), "key", "at", "start")
    assert {r["i"]: r["entry"] and tuple(r["entry"]) for r in out.collect()} == want
    assert "Broadcast" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert pages.as_of_keyed(frame, spark.createDataFrame([], "key string, start int, name string"), "key", "at", "start").filter("entry is not null").count() == 0


def test_packing_fold_equals_the_loop(spark):
    rng = random.Random(9)
    texts = [None, "", "  ", "One. Two! three", ". . ."] + [" ".join(" ".join("w" for _ in range(rng.choice([0, 1, 3, 9, 40]))) + rng.choice([".", "!", "?", ",", ""]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size, overlap in ((12, 0), (12, 5), (40, 39), (1, 1)):
        want = set()
        for i, t in enumerate(texts):
            own = fragments.sentences(t)
            counts = [len(x.split()) for x in own]
            want |= {(i, pos, s, e, sum(counts[s - 1 : e]), " ".join(own[s - 1 : e])) for pos, (s, e) in enumerate(fragments.spans(counts, size, overlap))}
        out = fragments.fragments(frame, size, overlap)
        assert {(r["doc_id"], r["pos"], r["first"], r["last"], r["n_words"], r["text"]) for r in out.collect()} == want
    assert "Python" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and "Pandas" not in plan


def test_sweep_and_bands_by_histogram(spark):
    rng = random.Random(2)
    steps, edges = [0.1, 0.4, 0.5, 0.8], [0.0, 0.3, 0.6, 1.01]
    rows = [(i, rng.choice(["respondible", "fuera", "ambigua"]), rng.choice([0.0, 0.1, 0.39, 0.4, 0.5, 0.79, 0.8, 1.0]), rng.choice([None, 0.1, 0.5, 0.9]), rng.choice([None, 1, 2])) for i in range(300)]
    frame = spark.createDataFrame(rows, "qid long, category string, best double, hit_score double, hit_rank int")
    pct = lambda a, b: round(100 * a / b, 1) if b else 0.0
    inside, out = ([r for r in rows if r[1] == c] for c in ("respondible", "fuera"))
    want = {(t, pct(sum(r[2] < t for r in out), len(out)), pct(sum(r[2] < t for r in inside), len(inside)), pct(sum(r[3] is not None and r[3] >= t for r in inside), len(inside)), sum(r[1] == "ambigua" and r[2] < t for r in rows)) for t in steps}
    assert set(map(tuple, evaluation.sweep(frame, steps).collect())) == want
    want = {(lo, min(hi, 1.0), sum(lo <= r[2] < hi for r in inside), pct(sum(lo <= r[2] < hi and r[4] == 1 for r in inside), sum(lo <= r[2] < hi for r in inside)), sum(lo <= r[2] < hi for r in out)) for lo, hi in zip(edges, edges[1:])}
    assert set(map(tuple, evaluation.bands(frame, edges).collect())) == want


def test_short_items_are_found_in_one_pass(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "xalphax"), (2, "Alpha beta"), (3, None), (4, "a b. c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha"), (2, "b. c"), (3, ""), (4, None), (5, "zz"), (6, "alpha"), (7, ".")], "item_id long, text string")
    want = {(1, 1), (6, 1), (2, 4), (7, 4)}
    assert set(map(tuple, retrieval.holders(items, docs).collect())) == want
    monkeypatch.setattr(retrieval, "PAIRS_SHIPPED", 1)
    assert set(map(tuple, retrieval.holders(items, docs).collect())) == want
