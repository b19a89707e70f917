"""A fitted text encoder as a Spark ML pipeline: hashed word pairs, weighted by how few texts have them, as unit vectors."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, CountVectorizerModel, NGram, Normalizer, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = 256


def _text(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("_text", F.coalesce(text, F.lit("")))


def fit(df: DataFrame, text: str = "text", cells: int = CELLS) -> PipelineModel:
    """Weights of `cells` cells from all texts of df, ln((texts + 1) / (texts with the cell + 1)). A pair's cell is its MD5's first 32 bits mod cells.

    The vocabulary is the cells' numbers, so its size is fixed and nothing of the corpus but one count a cell reaches the driver.
    """
    numbered = f"SELECT *, transform(_pairs, p -> cast(cast(conv(substr(md5(p), 1, 8), 16, 10) AS bigint) % {cells} AS string)) AS _cells FROM __THIS__"
    stages = [
        RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"[\p{L}\p{N}]+", gaps=False),
        NGram(n=2, inputCol="_words", outputCol="_pairs"),
        SQLTransformer(statement=numbered),
        CountVectorizerModel.from_vocabulary([str(i) for i in range(cells)], inputCol="_cells", outputCol="_counts", minTF=1.0),
        IDF(inputCol="_counts", outputCol="_weighted"),
        Normalizer(inputCol="_weighted", outputCol="_unit"),
    ]
    return Pipeline(stages=stages).fit(_text(df, text).select("_text"))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def weights(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """(cell, n_texts, weight) of a fitted model, one row a cell."""
    idf = model.stages[-2]
    return spark.createDataFrame([(i, int(n), float(w)) for i, (n, w) in enumerate(zip(idf.docFreq, idf.idf))], "cell int, n_texts long, weight double")


def encoded(df: DataFrame, model: PipelineModel, is_query: bool = False, text: str = "text") -> DataFrame:
    """df with embedding array<double>. A passage's cells count as often as they occur, a question's once each; no pair: all zero."""
    counts = next(s for s in model.stages if isinstance(s, CountVectorizerModel))
    rows = model.transform(_text(df, text), {counts.binary: is_query})
    return rows.withColumn("embedding", vector_to_array("_unit")).select(*df.columns, "embedding")
