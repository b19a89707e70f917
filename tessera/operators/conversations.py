"""Tables of chats: titles, search, patches, pending replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TITLE_CHARS = 42
DEFAULT_TITLE, DEFAULT_PREVIEW = "New conversation", "Ask about the guide"


def rollup(turns: DataFrame) -> DataFrame:
    """(conv_id, title, preview, turns): first and last user text, trimmed; defaults where a user said nothing."""
    said = F.trim("text")
    user = (F.col("role") == "user") & (said != "")
    order = F.when(user, F.col("turn"))
    return turns.groupBy("conv_id").agg(
        F.coalesce(F.substring(F.min_by(said, order), 1, TITLE_CHARS), F.lit(DEFAULT_TITLE)).alias("title"),
        F.coalesce(F.max_by(said, order), F.lit(DEFAULT_PREVIEW)).alias("preview"),
        F.count("*").alias("turns"),
    )


def search(chats: DataFrame, query: str) -> DataFrame:
    """Chats whose title or preview holds the query in any case; an empty query finds all."""
    return chats.filter(F.contains(F.lower(F.concat_ws(" ", "title", "preview")), F.lit(query.lower())))


def patched(messages: DataFrame, patches: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """messages with the latest patch (greatest seq) of each key; null fields of a patch change nothing."""
    last = patches.groupBy(*keys).agg(F.max_by(F.struct(*fields), "seq").alias("_p"))
    changed: list[Column] = [F.coalesce(F.col(f"_p.{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in messages.columns]
    return messages.join(last, keys, "left").select(*changed)


def pending(turns: DataFrame) -> DataFrame:
    """(conv_id, pending): whether the last turn waits for a reply."""
    return turns.groupBy("conv_id").agg((F.max_by("role", "turn") == "user").alias("pending"))
