"""The bounded search by word pairs against the plain one."""

import random

import pytest

from tessera.operators import pair_index, retrieval

DIR = "/root/testdata"
Q, F_ = "item_id long, text string", "doc_id long, text string"


def hits(df):
    return sorted(tuple(r) for r in df.select("qid", "fid", "score", "pair_score", "rank").collect())


@pytest.mark.parametrize("k, first", [(1, 0.1), (5, 0.1), (20, 0.0), (5, 1.0)])
def test_bounded_equals_plain(spark, tmp_path, monkeypatch, k, first):
    monkeypatch.setattr(pair_index, "FIRST", first)
    rng = random.Random(k)
    # few words, so that many fragments tie; lengths from nothing to hundreds of words
    words = [chr(97 + i) for i in range(9)]
    text = lambda n: " ".join(rng.choices(words, [9, 8, 6, 4, 3, 2, 1, 1, 1], k=n))
    rows = [(i, text(rng.choice([0, 1, 2, 5, 12, 40, 150, 400]))) for i in range(250)] + [(900, None), (901, ""), (902, "a")]
    rows += [(1000 + i, rows[i % 7 * 31][1]) for i in range(60)]
    asked = [(i, text(rng.choice([2, 4, 9, 25]))) for i in range(25)] + [(90, None), (91, "a"), (92, "zz yy"), (93, rows[93][1])]
    questions, fragments = spark.createDataFrame(asked, Q), spark.createDataFrame(rows, F_)
    pair_index.write_by_length(fragments, str(tmp_path))
    found, report = pair_index.search(questions, str(tmp_path), k)
    assert hits(found) == hits(retrieval.lexical(questions, fragments, k))
    assert [r["step"] for r in report.collect()] == ["all", "first", "rare", "looked_up"]


def test_nothing(spark, tmp_path):
    none = spark.createDataFrame([], F_)
    pair_index.write_by_length(none, str(tmp_path))
    found, report = pair_index.search(spark.createDataFrame([(1, "a b c")], Q), str(tmp_path), 3)
    assert found.count() == 0 and {r["postings"] for r in report.collect()} == {0}
    pair_index.write_by_length(spark.createDataFrame([(1, "a b c")], F_), str(tmp_path))
    assert pair_index.search(spark.createDataFrame([], Q), str(tmp_path), 3)[0].count() == 0


def test_at_most_half_of_the_postings_are_read(spark, tmp_path):
    questions, fragments = (spark.read.parquet(f"{DIR}/sf0.1/{t}.parquet") for t in ("benchmark", "documents"))
    pair_index.write_by_length(fragments, str(tmp_path))
    found, report = pair_index.search(questions, str(tmp_path), 20)
    assert hits(found) == hits(retrieval.lexical(questions, fragments, 20))
    n = {r["step"]: r["postings"] for r in report.collect()}
    print(n)
    assert n["first"] + n["rare"] + n["looked_up"] <= n["all"] / 2
