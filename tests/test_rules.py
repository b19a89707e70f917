"""Rules of the operators on small cases."""

from hypothesis import given
from hypothesis import strategies as st

from tessera import config
from tessera.operators import evaluation, fragments, gate, pages, retrieval
from tessera.plans import catalogue
from tessera.sources import corpus


def test_page_location(spark):
    want = {  # page: (section's number, activity's, tool's, stage), 0 for none
        2: (1, 0, 0, None), 53: (12, 0, 0, None), 54: (12, 1, 0, None), 108: (12, 13, 0, 1), 110: (12, 13, 13, 1), 132: (12, 18, 0, 4),
        137: (12, 18, 19, 4), 148: (12, 19, 21, 2), 157: (12, 21, 23, 5), 158: (13, 0, 0, None),
    }
    rows = pages.located(spark.createDataFrame([(p,) for p in want], "page int")).withColumn("label", pages.label()).collect()
    for r in rows:
        s, a, t, stage = want[r["page"]]
        name = lambda kind, n: f"{kind} {n:02d}" if n else ""
        assert (r["seccion"], r["actividad"], r["herramienta"], r["etapa"]) == (name("Section", s), name("Activity", a), name("Tool", t), stage)
        first = name("Activity", a) or name("Section", s)
        assert r["label"] == (f"{first} › {name('Tool', t)}" if t else first) + f", p. {r['page']}"


@given(st.lists(st.integers(1, 60), max_size=40), st.integers(1, 90), st.integers(0, 30))
def test_spans_cover_and_fit(counts, size, overlap):
    spans = list(fragments.spans(counts, size, overlap))
    covered = {i for s, e in spans for i in range(s, e + 1)}
    assert covered == set(range(1, len(counts) + 1))
    for s, e in spans:
        assert s == e or sum(counts[s - 1 : e]) <= size
    assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(spans, spans[1:]))


def test_refusal_and_confidence(spark):
    quest = spark.createDataFrame([(1,), (2,), (3,)], "qid long")
    hits = spark.createDataFrame([(1, 1, 0.8996), (1, 2, 0.4), (2, 1, 0.4999)], "qid long, rank int, score double")
    g = gate.gated(quest, hits)
    answers = spark.createDataFrame([(1, "yes")], "qid long, answer string")
    out = {r["qid"]: r for r in gate.classified(g, answers).collect()}
    assert (out[1]["confianza"], out[1]["encontrada"], out[1]["puntaje"]) == ("alta", True, 0.9)
    assert out[2]["resultado"].startswith(config.REFUSAL) and not out[2]["encontrada"] and out[2]["puntaje"] == 0.5
    assert out[3]["puntaje"] is None and out[3]["confianza"] is None


def test_sweep_bands_and_gap(spark):
    rows = [(1, "respondible", 0.9, 1, 0.9), (2, "respondible", 0.55, 2, 0.3), (3, "fuera", 0.4, None, None), (4, "ambigua", 0.2, None, None)]
    s = spark.createDataFrame(rows, "qid long, category string, best double, hit_rank int, hit_score double")
    swept = {r["umbral"]: r for r in evaluation.sweep(s).collect()}
    assert (swept[0.5]["rechazo_fuera"], swept[0.5]["falsos_no_encuentro"], swept[0.5]["recall"], swept[0.5]["ambiguas_rechazadas"]) == (100.0, 0.0, 50.0, 1)
    assert swept[0.4]["rechazo_fuera"] == 0.0
    assert evaluation.safe(evaluation.sweep(s)).first()["thresholds"] == "0.50"
    bands = evaluation.bands(s).orderBy("desde").collect()
    assert len(bands) == 6 and bands[-1]["hasta"] == 1.0 and bands[-1]["respondibles"] == 1
    assert evaluation.class_gap(s).first().asDict() == {"weakest": 2, "weakest_score": 0.55, "strongest": 3, "strongest_score": 0.4}


def test_rebuild_leaves_other_tags(spark, tmp_path):
    path = str(tmp_path / "fragments")
    both = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "fid long, indice string")
    corpus.rebuild(both, path)
    corpus.rebuild(spark.createDataFrame([(9, "b")], "fid long, indice string"), path)
    out = spark.read.parquet(path)
    assert sorted(map(tuple, out.select("fid", "indice").collect())) == [(1, "a"), (9, "b")]
    for bad in ("a", "zzz"):
        try:
            corpus.require(out, bad)
        except ValueError:
            continue
        raise AssertionError("a foreign tag went through")


def _tables(spark, folder, docs, items):
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_item_held_beyond_the_candidates_is_answerable(spark, tmp_path):
    item = "alpha beta gamma delta epsilon"
    long_ = " ".join(f"w{i}" for i in range(4000))
    docs = [(i, f"alpha beta only {i}") for i in range(25)] + [(99, f"{long_} x{item}s {long_}")]
    d = _tables(spark, tmp_path, docs, [(1, item), (2, "alpha beta nowhere gamma delta"), (3, ""), (4, None), (5, "pha bet")])
    assert 99 not in {r["fid"] for r in catalogue._candidates(spark, d).filter("qid = 1").collect()}
    kinds = {r["qid"]: (r["category"], r["hit_rank"]) for r in catalogue.queries()["score_table"](spark, d).collect()}
    assert kinds == {1: ("respondible", None), 2: ("fuera", None), 3: ("fuera", None), 4: ("fuera", None), 5: ("respondible", None)}
    assert catalogue.queries()["compare_rerank"](spark, d).first().asDict() == {"questions": 2, "dense": 0.0, "reranked": 0.0}


def test_requests(spark):
    rows = [("", None), ("  ", None), ("x" * 1001, None), ("ok", 8), ("ok", 7), (None, None)]
    out = [r["reason"] for r in gate.checked(spark.createDataFrame(rows, "text string, stage int")).collect()]
    assert out == ["empty", "blank", "too long", "stage", None, "empty"]


def test_entry_works_without_training_data_operators(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 2


def test_scores_to_four_decimals_by_their_binary_value(spark):
    hits = spark.createDataFrame([(1, 1, 0.15625, True), (1, 2, 0.03125, False), (2, 1, 0.00015, True)], "qid long, rank int, score double, hit boolean")
    quest = spark.createDataFrame([(1, "respondible"), (2, "respondible")], "qid long, category string")
    out = {r["qid"]: r for r in evaluation.score_table(hits, quest).collect()}
    assert (list(out[1]["scores"]), out[1]["best"], out[1]["hit_score"]) == ([round(0.15625, 4), round(0.03125, 4)], 0.1562, 0.1562)
    assert out[2]["best"] == round(0.00015, 4)


def test_hits_by_name(spark):
    rows = [(1, 1, "Sección Uno", "", "", "SECCION uno "), (1, 2, "x", "Café", "", "cafe"), (1, 3, "x", "", "Mapa", "mapa"), (1, 4, "x", "", "", ""), (1, 5, "x", "y", "z", None), (1, 6, None, None, None, "q")]
    ranked = spark.createDataFrame(rows, "qid long, rank int, seccion string, actividad string, herramienta string, expected string")
    assert [r["hit"] for r in evaluation.named_hits(ranked).orderBy("rank").collect()] == [True, True, True, False, False, False]
    found = spark.createDataFrame([(1, True), (2, False)], "qid long, page_hit boolean")
    three = spark.createDataFrame([(1,), (2,), (3,)], "qid long")
    assert evaluation.page_metrics(found, three).first().asDict() == {"questions": 3, "recall_page": 33.3, "misses": 2}


def test_many_questions_are_dealt_out_in_blocks(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    f = catalogue._vectors(spark, d)
    q = f.filter("fid % 5 = 0").toDF("qid", "qv", "qlabel")
    want = sorted(map(tuple, retrieval.nearest(q, f, 3).collect()))
    monkeypatch.setattr(retrieval, "QUESTION_BLOCK", 7)
    monkeypatch.setattr(retrieval, "FRAGMENT_BLOCK", 30)
    assert sorted(map(tuple, retrieval.nearest(q, f, 3).collect())) == want
    assert retrieval.nearest(q.limit(0), f, 3).count() == 0


def test_pairs_beyond_the_shipped_set_are_joined(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "b c x"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b c"), (8, "")], "item_id long, text string")
    want = sorted(map(tuple, retrieval.lexical(items, docs, 5).collect()))
    monkeypatch.setattr(retrieval, "PAIRS_SHIPPED", 1)
    assert sorted(map(tuple, retrieval.lexical(items, docs, 5).collect())) == want and len(want) == 2


def test_files_against_a_manifest(spark, tmp_path):
    import hashlib

    for name, content in (("a.pdf", b"one"), ("b.pdf", b"two"), ("c.pdf", b"three")):
        (tmp_path / name).write_bytes(content)
    manifest = spark.createDataFrame([("a.pdf", hashlib.sha256(b"one").hexdigest()), ("b.pdf", "0")], "name string, sha256 string")
    out = corpus.fingerprints(corpus.read_files(spark, str(tmp_path)), manifest)
    assert {r["name"]: r["status"] for r in out.collect()} == {"a.pdf": "match", "b.pdf": "changed", "c.pdf": "unlisted"}


def test_pages_with_missing_figures_are_set_apart(spark):
    blocks = spark.createDataFrame([(1, 0, "text", "t"), (1, 1, "picture", "p"), (2, 0, "picture", "p"), (2, 1, "footer", "f")], "doc_id long, pos int, kind string, text string")
    figures = spark.createDataFrame([(1, 1, "[Figura] some words here")], "doc_id long, fig_id int, text string")
    whole, apart = pages.assembled(blocks, figures)
    assert [r["text"] for r in whole.collect()] == ["t\n\n[Figura] some words here"] and [r["doc_id"] for r in apart.collect()] == [2]


def test_repeated_requests_are_answered_once(spark, tmp_path):
    from tessera.streaming import answers, page_index

    d = "/root/testdata/sf0.001"
    items = spark.read.parquet(f"{d}/benchmark.parquet").limit(3)
    asked = items.selectExpr("item_id AS qid", "text AS question", "CAST(NULL AS INT) AS stage", "timestamp'2026-01-01 00:00:00' AS at")
    asked.unionByName(asked).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(asked.schema).parquet(str(tmp_path / "in"))
    rows = pages.located(pages.pages_of(spark.read.parquet(f"{d}/documents.parquet"))).withColumn("fuente", pages.label())
    page_index.append(rows, str(tmp_path / "index"), 0)
    answers.start(stream, str(tmp_path / "index"), str(tmp_path / "out"), str(tmp_path / "offsets"), event_time="at").awaitTermination()
    assert sorted(r["qid"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(r["item_id"] for r in items.collect())
