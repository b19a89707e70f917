"""From ranked fragments to answers: threshold, refusal, citations, prompt, answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import ADVICE, DEFAULT, REFUSAL, STAGES, Settings
from tessera.functions.scores import confidence
from tessera.functions.text import source_text

SEPARATOR = "\n\n---\n\n"


def above(hits: DataFrame, threshold: float = DEFAULT.threshold, score: str = "score") -> DataFrame:
    """Hits at or above the threshold, on unrounded scores."""
    return hits.filter(F.col(score) >= threshold)


def gated(questions: DataFrame, hits: DataFrame, threshold: float = DEFAULT.threshold) -> DataFrame:
    """(qid, found, best, n_kept) of every question: best is from before the cut, found says whether anything is left."""
    per = hits.groupBy("qid").agg(F.max("score").alias("best"), F.count_if(F.col("score") >= threshold).alias("n_kept"))
    out = questions.select("qid").join(per, "qid", "left")
    return out.select("qid", (F.coalesce("n_kept", F.lit(0)) > 0).alias("found"), F.round("best", 3).alias("best"), F.coalesce("n_kept", F.lit(0)).alias("n_kept"))


def most_specific() -> Column:
    return F.coalesce(F.nullif("herramienta", F.lit("")), F.nullif("actividad", F.lit("")), "seccion")


def cited(hits: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """One row per hit, as an answer cites it."""
    return hits.select(
        "qid", "rank", most_specific().alias("seccion"), F.col("pagina_inicio").alias("pagina"), "fuente",
        F.substring("text", 1, settings.quote_chars).alias("fragmento"), F.round("score", 3).alias("puntaje"),
    )


def contexts(hits: DataFrame) -> DataFrame:
    """(qid, context): fragments in rank order, each with its source line. A question has at most top_k hits."""
    body = source_text(F.col("fuente"), F.col("text"))
    listed = F.array_sort(F.collect_list(F.struct("rank", body.alias("body"))))
    return hits.groupBy("qid").agg(F.array_join(F.transform(listed, lambda x: x["body"]), SEPARATOR).alias("context"))


def prompts(questions: DataFrame, context: DataFrame) -> DataFrame:
    """(qid, prompt) of the questions that have a context; questions carry question and stage (null or 0: not given)."""
    stage = F.broadcast(questions.sparkSession.createDataFrame(STAGES, "_stage int, _label string"))
    rows = questions.join(context, "qid").join(stage, F.col("stage") == F.col("_stage"), "left")
    named = F.when(F.coalesce("stage", F.lit(0)) == 0, "not given").otherwise(F.coalesce("_label", F.col("stage").cast("string")))
    text = F.concat(F.lit("Stage: "), named, F.lit("\n\nContext:\n"), F.col("context"), F.lit("\n\nQuestion: "), F.col("question"))
    return rows.select("qid", text.alias("prompt"))


def answered(prompt: DataFrame, answerer_factory: Callable[[], Callable[[list[str]], list[str]]]) -> DataFrame:
    """(qid, answer) by an injected answerer, built once per task."""
    def run(batches):
        answer = answerer_factory()
        for pdf in batches:
            yield pdf[["qid"]].assign(answer=answer(pdf["prompt"].tolist()))

    return prompt.select("qid", "prompt").mapInPandas(run, "qid long, answer string")


def extractive() -> Callable[[list[str]], list[str]]:
    """An answerer without a model: the first fragment's text, or the refusal."""
    def first(prompt: str) -> str:
        context = prompt.split("\n\nContext:\n", 1)[1].rsplit("\n\nQuestion: ", 1)[0]
        body = context.split(SEPARATOR)[0].split("\n\n", 1)
        return body[1].strip() if len(body) > 1 and body[1].strip() else REFUSAL

    return lambda prompts: [first(p) for p in prompts]


def classified(gate: DataFrame, answers: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Answers of all questions: refused ones get the fixed text; an answer that begins with the refusal counts as none."""
    rows = gate.join(answers, "qid", "left")
    found = F.col("found") & ~F.coalesce(F.startswith("answer", F.lit(REFUSAL)), F.lit(False))
    return rows.select(
        "qid",
        F.when(F.col("found"), F.col("answer")).otherwise(f"{REFUSAL} {ADVICE}").alias("resultado"),
        found.alias("encontrada"),
        F.when(found, confidence(F.col("best"), settings)).alias("confianza"),
        F.col("best").alias("puntaje"),
    )


def checked(requests: DataFrame, text: str = "text", stage: str = "stage") -> DataFrame:
    """requests with reason: null if valid, else what is wrong."""
    reason = (
        F.when(F.coalesce(F.length(text), F.lit(0)) < 1, "empty").when(F.length(text) > 1000, "too long").when(F.trim(text) == "", "blank")
        .when(F.col(stage).isNotNull() & ~F.col(stage).between(1, 7), "stage")
    )
    return requests.withColumn("reason", reason)
