"""Questions as a stream: each micro-batch is retrieved, gated and answered by the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import DEFAULT, Settings
from tessera.operators import gate, retrieval
from tessera.session import materialized
from tessera.streaming import page_index

#: So many hits of a batch of questions are broadcast at most.
HITS_SHIPPED = 1 << 19


def _from(candidates: DataFrame, requests: DataFrame, pages: DataFrame, version: list[str], answerer: Callable, settings: Settings) -> DataFrame:
    top = retrieval.reranked(candidates, settings.top_k)
    hits = materialized(top.select("qid", F.col("final_rank").alias("rank"), F.col("pair_score").alias("score"), F.col("fid").alias("doc_id"), *version), "hits")
    passed = gate.above(hits, settings.threshold)
    # pages stay where they are, unless hits are too many to be sent to them
    passed = pages.join(F.broadcast(passed) if passed.count() <= HITS_SHIPPED else passed, ["doc_id", *version])
    prompt = gate.prompts(requests, gate.contexts(passed))
    return gate.classified(gate.gated(requests, hits, settings.threshold), gate.answered(prompt, answerer), settings)


def answer(requests: DataFrame, pages: DataFrame, answerer: Callable = gate.extractive, settings: Settings = DEFAULT) -> DataFrame:
    """Answers of (qid, question, stage) over pages (doc_id, text and the page metadata)."""
    candidates = retrieval.lexical(requests.select("qid", F.col("question").alias("text")), pages, settings.candidates, qid="qid")
    return _from(candidates, requests, pages, [], answerer, settings)


def answer_from(requests: DataFrame, index: str, answerer: Callable = gate.extractive, settings: Settings = DEFAULT) -> DataFrame:
    """Answers from the pages that the index at path `index` holds by now (see page_index)."""
    candidates = page_index.candidates(requests.select("qid", F.col("question").alias("text")), index, settings.candidates)
    return _from(candidates, requests, page_index.pages_of(requests.sparkSession, index), ["batch"], answerer, settings)


def start(requests: DataFrame, index: str, path: str, checkpoint: str, event_time: str | None = None, late: str = "10 minutes", **trigger):
    """Answer a streaming requests frame into Parquet at path, from a page index that may grow meanwhile.

    Each micro-batch sees the pages whose batch was complete when it began, and reads the index partitions of its own word pairs.
    With an event_time column, repeated request ids are dropped within the watermark, so state stays bounded.
    """
    if event_time:
        requests = requests.withWatermark(event_time, late).dropDuplicatesWithinWatermark(["qid"])

    def each(batch: DataFrame, number: int) -> None:
        answer_from(batch, index).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return requests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
