"""Findings of round 3: whole references, word pairs in expressions, scores in slices."""

import tracemalloc

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tessera.operators import pair_index, retrieval
from tessera.plans import catalogue


def test_clean_text_leaves_cut_references(spark, tmp_path):
    html = ["a &amp b &copy c &quot", "x &amp;lt; &lt;b&gt; &#39;q&#39; &nbsp; &eacute; &#x27;", "a \rb  c \u0085\n\n\n\nd \t\r\n", "\x0b a \x0b", " \x85 a \x85", "&am&amp;p;", "", None]
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame(list(enumerate(html)), "page_id long, html string").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/*.parquet'")
    want = sorted(con.execute(catalogue.oracle_sql()["clean_text"]).fetchall())
    assert sorted(map(tuple, catalogue.queries()["clean_text"](spark, str(tmp_path)).collect())) == want


def test_word_pairs_in_expressions(spark):
    texts = ["One two, one TWO three", "", None, "a", "Ärger über Öl ärger Über", "x\u0000y\nz 3½ 中文 字", "don't stop \U0001d400b c"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    posted = retrieval.postings(rows)
    assert "Python" not in (plan := posted._jdf.queryExecution().toString()) and "Pandas" not in plan
    want = {(i, len(retrieval.pairs_of(t)), p) for i, t in enumerate(texts) for p in retrieval.pairs_of(t)}
    assert sorted(map(tuple, posted.collect())) == sorted(want)


def test_scores_are_held_in_slices():
    rng = np.random.default_rng(1)
    q, f = rng.normal(size=(1500, 8)), rng.normal(size=(20000, 8))
    ids, best = np.arange(1500), [retrieval.NONE] * 1500
    tracemalloc.start()
    # all scores at once are 240 MB, rounded 480
    retrieval.best_of(ids, q, np.arange(20000), f, best, 5)
    assert tracemalloc.get_traced_memory()[1] < 30e6
    tracemalloc.stop()
    for i in (0, 700, 1499):
        s = np.round(f @ q[i], 6)
        order = [x for x in np.lexsort((np.arange(20000), -s)) if x != i][:5]
        assert best[i][1].tolist() == order and np.allclose(best[i][0], s[order])


def test_index_by_length_reads_texts_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    rows = spark.createDataFrame([(i, f"a b c{i % 7} d") for i in range(50)], "doc_id long, text string").repartition(4)
    pair_index.write_by_length(rows.select("doc_id", seen("text").alias("text")), str(tmp_path))
    assert read.value == 50
