"""Each registered query of the retrieval library against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tessera.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def rows(frame: pd.DataFrame) -> list:
    def plain(v):
        if v is None or v is pd.NA or v != v:
            return None
        if isinstance(v, bool) or type(v).__name__ in ("bool", "bool_"):
            return bool(v)
        return v if isinstance(v, str) else round(float(v), 9)

    return sorted((tuple(map(plain, r)) for r in frame[sorted(frame.columns)].astype(object).values.tolist()), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    own, sql = catalogue.queries()[name](spark, DIR).toPandas(), duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(own.columns) == sorted(sql.columns)
    assert rows(own) == rows(sql)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert catalogue.queries()[name](spark, DIR).count() > 0


def test_stream_equals_batch(spark):
    from pyspark.sql import functions as F

    from tessera.operators import pages
    from tessera.session import table
    from tessera.streaming import answers

    asked = table(spark, DIR, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"), (F.col("item_id") % 9).cast("int").alias("stage"))
    corpus = pages.located(pages.pages_of(table(spark, DIR, "documents"))).withColumn("fuente", pages.label())
    assert rows(answers.answer(asked, corpus).toPandas()) == rows(catalogue.queries()["stream_answers"](spark, DIR).toPandas())


def test_approximate_recall_is_reported_and_high(spark):
    assert catalogue.queries()["ann_recall"](spark, DIR).first()["recall"] >= 0.9
