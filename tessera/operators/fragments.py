"""Fragments: whole sentences packed up to a budget of words, with shared sentences between neighbours."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import DEFAULT

SENTENCE_END = re.compile(r"([.!?])\s+")


def sentences(text: str) -> list[str]:
    return [s for s in SENTENCE_END.sub("\\1\x01", text or "").split("\x01") if s.split()]


def spans(counts: list[int], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(first, last) sentence of each fragment, from 1. A sentence above the budget is a fragment of its own.

    The next fragment begins with as many of the last sentences as fit into the overlap, and into the budget together with
    the sentence that follows.
    """
    sums, n, s = [0, *accumulate(counts)], len(counts), 1
    while n:
        e = max(s, bisect_right(sums, sums[s - 1] + size) - 1)
        yield s, e
        if e >= n:
            return
        s = min(e + 1, max(s + 1, bisect_left(sums, max(sums[e] - overlap, sums[e + 1] - size)) + 1))


def sweep(pages: DataFrame, grid: list[tuple[int, int]], text: str = "text") -> DataFrame:
    """(size, overlap, n, words, longest) of the fragments under each setting; a text is split into sentences once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t in pdf[text]:
                sums = [0, *accumulate(len(x.split()) for x in sentences(t))]
                counts = [b - a for a, b in zip(sums, sums[1:])]
                for size, overlap in grid if counts else ():
                    own = [sums[e] - sums[s - 1] for s, e in spans(counts, size, overlap)]
                    rows.append((size, overlap, len(own), sum(own), max(own)))
            per = pd.DataFrame(rows, columns=["size", "overlap", "n", "words", "longest"])
            yield per.groupby(["size", "overlap"], as_index=False).agg({"n": "sum", "words": "sum", "longest": "max"})

    parts = pages.select(text).mapInPandas(run, "size int, overlap int, n long, words long, longest long")
    return parts.groupBy("size", "overlap").agg(F.sum("n").alias("n"), F.sum("words").alias("words"), F.max("longest").alias("longest"))


def _packed(counts: Column, size: int, overlap: int) -> Column:
    """array<struct<s,e>> of `spans`, as a fold over sentences' word counts.

    The state is the number i of sentences read, the words p before the next one, the first sentence s of the open fragment, and for
    each of its sentences the words before it (`tail`, rising). A sentence that doesn't fit closes the fragment; the next begins at the
    first sentence whose words before it leave no more than the overlap, and room for the sentence at hand.
    """
    long = "bigint"
    start = F.struct(F.lit(0).cast(long).alias("i"), F.lit(0).cast(long).alias("p"), F.lit(1).cast(long).alias("s"), F.expr("array(0L)").alias("tail"), F.expr("cast(array() as array<struct<s:bigint,e:bigint>>)").alias("out"))

    def step(at: Column, w: Column) -> Column:
        i, p, s, tail, w = at["i"] + 1, at["p"], at["s"], at["tail"], w.cast(long)
        over = (i > s) & (p + w - tail[0] > size)
        limit = F.greatest(p - overlap, p + w - size)
        kept = F.filter(F.concat(F.slice(tail, 2, F.size(tail)), F.array(p)), lambda x: x >= limit)
        opened = F.when(F.size(kept) > 0, kept).otherwise(F.array(p))
        grown = F.when(at["i"] == 0, tail).otherwise(F.concat(tail, F.array(p)))
        fresh = F.when(over, opened).otherwise(grown)
        return F.struct(
            i.alias("i"), (p + w).alias("p"), F.when(over, i - F.size(opened) + 1).otherwise(s).cast(long).alias("s"), fresh.alias("tail"),
            F.when(over, F.concat(at["out"], F.array(F.struct(s.alias("s"), (i - 1).alias("e"))))).otherwise(at["out"]).alias("out"),
        )

    return F.aggregate(counts, start, step, lambda at: F.when(at["i"] > 0, F.concat(at["out"], F.array(F.struct(at["s"].alias("s"), at["i"].alias("e"))))).otherwise(at["out"]))


def fragments(pages: DataFrame, size: int = DEFAULT.chunk_tokens, overlap: int = DEFAULT.chunk_overlap, text: str = "text") -> DataFrame:
    """pages with pos, first, last, n_words and the fragment's text in place of the page's; other columns are inherited.

    Texts without words, null ones too, have no fragments. All in expressions: a text is split once, its sentences are counted, a fold
    packs them, and ranges of sentences become rows.
    """
    cut = F.split(F.coalesce(F.col(text), F.lit("")), r"(?<=[.!?])\s+")
    own = [c for c in pages.columns if c != text]
    rows = pages.select(*(F.col(f"`{c}`") for c in own), F.filter(cut, lambda s: s.rlike(r"\S")).alias("tessera_sentences"))
    counted = rows.withColumn("tessera_counts", F.transform("tessera_sentences", lambda s: F.regexp_count(s, F.lit(r"\S+"))))
    # outer: an inner explode would be given a filter that repeats the fold
    ranged = counted.select("*", F.posexplode_outer(_packed(F.col("tessera_counts"), size, overlap)).alias("pos", "tessera_range")).filter("pos is not null")
    s, e = F.col("tessera_range.s"), F.col("tessera_range.e")
    part = [s.cast("int"), (e - s + 1).cast("int")]
    words = F.aggregate(F.slice("tessera_counts", *part), F.lit(0).cast("bigint"), lambda a, x: a + x)
    made = {text: F.array_join(F.slice("tessera_sentences", *part), " ")}
    return ranged.select(
        *(made[c].alias(c) if c == text else F.col(f"`{c}`") for c in pages.columns), F.col("pos").cast("bigint").alias("pos"), s.alias("first"), e.alias("last"), words.alias("n_words")
    )
