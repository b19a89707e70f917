"""Page corpora, questions, fragment tables, fingerprints and results as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = (
    "id string, texto string, fuente string, pagina_inicio int, pagina_fin int, seccion string, actividad string, herramienta string, etapa int,"
    " version_corpus string"
)
QUESTION = "id string, pregunta string, respuesta_esperada string, seccion_fuente string, pagina int, etapa int, categoria string, dificultad string"


def write_pages(pages: DataFrame, path: str) -> None:
    """JSON lines, one folder per corpus version."""
    pages.write.mode("overwrite").partitionBy("version_corpus").json(path)


def read_pages(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """Pages with the kept keys, stage 0 for none, and the index tag."""
    rows = spark.read.schema(PAGE).json(path)
    return rows.select("id", "texto", "fuente", "pagina_inicio", "pagina_fin", "seccion", "actividad", "herramienta", F.coalesce("etapa", F.lit(0)).alias("etapa"), F.lit(tag).alias("indice"))


def read_questions(spark: SparkSession, path: str, with_section: bool = True) -> DataFrame:
    rows = spark.read.schema(QUESTION).json(path).filter("id is not null")
    return rows.filter(F.coalesce("seccion_fuente", F.lit("")) != "") if with_section else rows


def rebuild(fragments: DataFrame, path: str) -> None:
    """Replace the partitions of the tags in fragments and leave other tags alone."""
    fragments.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("indice").parquet(path)


def copied(fragments: DataFrame, tag: str) -> DataFrame:
    """The same fragments and vectors under another tag."""
    return fragments.withColumn("indice", F.lit(tag))


def counts(fragments: DataFrame) -> DataFrame:
    return fragments.groupBy("indice").agg(F.count("*").alias("n"))


def require(fragments: DataFrame, tag: str) -> None:
    """Fail where the table is empty or holds another configuration's fragments."""
    tags = {r[0] for r in fragments.select("indice").distinct().limit(3).collect()}
    if not tags:
        raise ValueError("the index is empty")
    if tags != {tag}:
        raise ValueError(f"indexed as {sorted(tags)}, the configuration is {tag}")


def fingerprints(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, status) of (name, content) against (name, sha256): match, changed or unlisted."""
    own = files.select("name", F.sha2("content", 256).alias("own"))
    status = F.when(F.col("sha256").isNull(), "unlisted").when(F.col("sha256") == F.col("own"), "match").otherwise("changed")
    return own.join(manifest, "name", "left").select("name", status.alias("status"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def write_results(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)
