"""Nearest fragments: exact by vectors, by shared word pairs, approximate by cells; injected encoders and scorers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialized

#: Questions of a block: what a task holds of them, and what is broadcast at a time.
QUESTION_BLOCK, FRAGMENT_BLOCK = 4096, 16384
#: Rows that are turned into numbers at a time, and scores that a task holds at a time.
PIECE, SCORES = 2048, 1 << 19
NONE = np.zeros(0), np.zeros(0, np.int64)
#: So many distinct word pairs of questions are broadcast at most; beyond, fragments' pairs are joined with them.
PAIRS_SHIPPED = 1 << 19
WORD = regex.compile(r"[\p{L}\p{N}]+")


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties by id."""
    if len(scores) > k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def _unit(vectors) -> np.ndarray:
    m = np.stack([np.asarray(v, np.float64) for v in vectors])
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-300)


def best_of(ids: np.ndarray, vectors: np.ndarray, fids: np.ndarray, found: np.ndarray, best: list, k: int) -> None:
    """Keep each question's k best of what it has and of these fragments; at most about SCORES scores are held at a time."""
    step = max(1, SCORES // max(1, len(fids)))
    for lo in range(0, len(ids), step):
        scores = np.round(vectors[lo : lo + step] @ found.T, 6)
        for i, row in enumerate(scores, lo):
            own, other = best[i]
            ok = fids != ids[i]
            if len(own) == k:
                ok &= ~(row < own[-1])
            s, f = np.concatenate([own, row[ok]]), np.concatenate([other, fids[ok]])
            at = _top(s, f, k)
            best[i] = s[at], f[at]


def told(ids: np.ndarray, best: list) -> pd.DataFrame:
    """(qid, fid, score) of what `best_of` has kept."""
    sizes, none = [len(f) for _, f in best], [np.zeros(0)]
    return pd.DataFrame({"qid": np.repeat(np.asarray(ids, np.int64), sizes), "fid": np.concatenate([f for _, f in best] + none).astype(np.int64), "score": np.concatenate([s for s, _ in best] + none)})


def pieces(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """pdf in pieces of PIECE rows, so that what is made of them doesn't grow with a batch or a block."""
    for lo in range(0, len(pdf), PIECE):
        yield pdf.iloc[lo : lo + PIECE]


def nearest(questions: DataFrame, fragments: DataFrame, k: int) -> DataFrame:
    """(qid, fid, score, rank): the k fragments of greatest cosine (6 decimals, ties by id), never the question itself.

    Up to QUESTION_BLOCK questions (qid, qv) are broadcast; fragments (fid, fv) stay where they are and hand
    on k rows per question and task. More questions are dealt out in blocks of about that size, fragments in blocks of about
    FRAGMENT_BLOCK, and every pair of blocks is one group of one job. vector_index has the same with a filter by label.
    """
    spark = questions.sparkSession
    schema = "qid long, fid long, score double"
    questions, fragments = questions.select("qid", "qv"), fragments.select("fid", "fv")
    n = questions.count()
    if n > QUESTION_BLOCK:
        own, parts = -(-n // QUESTION_BLOCK), max(1, -(-fragments.count() // FRAGMENT_BLOCK))

        def block(key, asked: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
            best, ids = [NONE] * len(asked), asked["qid"].to_numpy()
            if len(asked):
                vectors = _unit(asked["qv"])
                for part in pieces(found):
                    best_of(ids, vectors, part["fid"].to_numpy(), _unit(part["fv"]), best, k)
            return told(ids, best)

        def dealt(df: DataFrame, key: str, mine: str, count: int, other: str, others: int) -> DataFrame:
            return df.withColumn(mine, F.pmod(F.xxhash64(key), F.lit(count)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

        asked = dealt(questions, "qid", "qb", own, "fb", parts).groupBy("qb", "fb")
        return ranked(asked.cogroup(dealt(fragments, "fid", "fb", parts, "qb", own).groupBy("qb", "fb")).applyInPandas(block, schema), k)
    rows = questions.orderBy("qid").collect()
    if not rows:
        return ranked(spark.createDataFrame([], schema), k)
    shipped = spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), _unit([r[1] for r in rows])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vectors = shipped.value
        best = [NONE] * len(ids)
        for pdf in batches:
            for part in pieces(pdf):
                best_of(ids, vectors, part["fid"].to_numpy(), _unit(part["fv"]), best, k)
        yield told(ids, best)

    return ranked(fragments.mapInPandas(run, schema), k)


def ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "fid")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def pairs_of(text: str | None) -> list[str]:
    """Distinct neighbouring word pairs, in lower case."""
    t = WORD.findall((text or "").lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(t, t[1:])))


def words_of(text: Column) -> Column:
    """The words of a text in lower case, in order; none of null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD.pattern), F.lit(0))


def distinct_pairs(words: Column) -> Column:
    """What `pairs_of` has of a text, of a column of its words."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b)))


def _postings(df: DataFrame, id_col: str) -> DataFrame:
    """(id, n, pair) of each text, in expressions: nothing but one text's words and pairs is held, and no Python runs."""
    pairs = df.select(F.col(id_col).cast("long").alias("id"), words_of(F.col("text")).alias("words")).select("id", distinct_pairs(F.col("words")).alias("pairs"))
    # outer: else the optimizer adds a filter by the array's size below, which makes words and pairs once more for each use of them
    return pairs.select("id", F.size("pairs").cast("long").alias("n"), F.explode_outer("pairs").alias("pair")).filter("pair IS NOT NULL")


def postings(fragments: DataFrame, fid: str = "doc_id", only: DataFrame | None = None) -> DataFrame:
    """(fid, nf, pair): the inverted index of fragments; with `only` (pair), which is broadcast, of no other pairs (nf counts all)."""
    rows = _postings(fragments, fid).select(F.col("id").alias("fid"), F.col("n").alias("nf"), "pair")
    return rows if only is None else rows.join(F.broadcast(only), "pair", "left_semi")


def asked(questions: DataFrame, qid: str = "item_id") -> DataFrame:
    """(qid, nq, pair) of questions, written, as their pairs are looked at and joined."""
    return materialized(_postings(questions, qid).select(F.col("id").alias("qid"), F.col("n").alias("nq"), "pair"), "asked")


def shared(asked: DataFrame, index: DataFrame, *version: str) -> DataFrame:
    """How many pairs a question and a fragment (of a version) share."""
    return counted(asked.join(index, "pair"), *version)


def counted(found: DataFrame, *version: str) -> DataFrame:
    """`shared`, of a row for each pair that a question and a fragment share."""
    return found.groupBy("qid", "fid", *version, "nq", "nf").agg(F.count("*").alias("shared"))


def pair_scores(shared: DataFrame, *version: str) -> DataFrame:
    return shared.select(
        "qid", "fid", *version, F.round(F.col("shared") / F.sqrt(F.col("nq") * F.col("nf")), 6).alias("score"), F.round(F.col("shared") / F.col("nq"), 6).alias("pair_score")
    )


def shipped(pairs: DataFrame) -> DataFrame | None:
    """The distinct pairs, to be broadcast; None if there are more than PAIRS_SHIPPED."""
    own = pairs.select("pair").distinct()
    return own if own.limit(PAIRS_SHIPPED + 1).count() <= PAIRS_SHIPPED else None


def indexed(questions: DataFrame, fragments: DataFrame, qid: str = "item_id", fid: str = "doc_id") -> DataFrame:
    """Stored postings of the fragments for all word pairs of the questions: one pass over texts for `lexical` and `holders`."""
    return materialized(postings(fragments, fid, shipped(asked(questions, qid))), "postings")


def lexical(questions: DataFrame, fragments: DataFrame, k: int, qid: str = "item_id", fid: str = "doc_id", index: DataFrame | None = None) -> DataFrame:
    """Candidates by shared word pairs: (qid, fid, score, rank, pair_score).

    score is shared / sqrt(pairs of both), pair_score shared / the question's pairs, both to 6 decimals. An inverted-index
    join over the fragments' texts; only pairs that questions have leave the tasks that read fragments, as long as questions
    have at most PAIRS_SHIPPED. With `index` (see indexed) no text is read. Texts without pairs find nothing.
    streaming.page_index has the same over a stored index.
    """
    q = asked(questions, qid)
    return ranked(pair_scores(shared(q, postings(fragments, fid, shipped(q)) if index is None else index)), k)


def shared_pairs_scorer() -> Callable[[list[tuple[str, str]]], list[float]]:
    """A pair scorer without a model: the share of a question's word pairs that a text has, to 6 decimals."""

    def score(pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for question, text in pairs:
            own = pairs_of(question)
            out.append(round(len(set(own) & set(pairs_of(text))) / max(1, len(own)), 6))
        return out

    return score


def holders(questions: DataFrame, fragments: DataFrame, qid: str = "item_id", fid: str = "doc_id", index: DataFrame | None = None) -> DataFrame:
    """(qid, fid) of every fragment whose text contains the question's, whatever its rank; empty texts have none.

    A question's first and last word may be parts of longer words in a fragment, the pairs between them may not. So fragments
    are looked up by the rarest of those pairs and then compared. Questions without such a pair, of three words or fewer, are
    looked for in every text by one search automaton in the tasks that read fragments (up to PAIRS_SHIPPED of them, else joined).
    """
    rows = questions.select(F.col(qid).cast("long").alias("qid"), F.col("text").alias("item")).filter("item != ''").withColumn("words", words_of(F.col("item")))
    inner = rows.withColumn("words", F.slice("words", 2, F.greatest(F.size("words") - 2, F.lit(0))))
    rows = materialized(inner.select("qid", "item", distinct_pairs(F.col("words")).alias("inner")), "items")
    texts = fragments.select(F.col(fid).alias("fid"), F.col("text").alias("body"))
    own = rows.select("qid", F.explode("inner").alias("pair"))
    found_in = (indexed(questions, fragments, qid, fid) if index is None else index).drop("nf").join(own.select("pair").distinct(), "pair", "left_semi")
    rarest = own.join(found_in.groupBy("pair").count(), "pair", "left").groupBy("qid").agg(F.min_by("pair", F.struct(F.coalesce("count", F.lit(0)), "pair")).alias("pair"))
    found = rarest.join(found_in, "pair").select("qid", "fid").distinct()
    found = found.join(texts, "fid").join(rows.select("qid", "item"), "qid").filter(F.contains("body", "item"))
    short = rows.filter(F.size("inner") == 0).select("qid", "item")
    return found.select("qid", "fid").unionByName(_containing(short, texts)).distinct()


def _containing(items: DataFrame, texts: DataFrame) -> DataFrame:
    """(qid, fid) of texts that contain an item, for items too short to be looked up by a pair."""
    some = items.limit(PAIRS_SHIPPED + 1).collect()
    if not some:
        return texts.sparkSession.createDataFrame([], "qid long, fid long")
    if len(some) > PAIRS_SHIPPED:
        return items.join(texts, F.contains("body", "item")).select("qid", "fid")
    known = texts.sparkSession.sparkContext.broadcast([tuple(r) for r in some])

    def run(batches):
        import ahocorasick

        by_item: dict[str, list[int]] = {}
        for q, item in known.value:
            by_item.setdefault(item, []).append(q)
        search = ahocorasick.Automaton()
        for item in by_item:
            search.add_word(item, item)
        search.make_automaton()
        for pdf in batches:
            for part in pieces(pdf):
                hits = [(q, f) for f, body in zip(part["fid"], part["body"]) for item in {x for _, x in search.iter(body or "")} for q in by_item[item]]
                yield pd.DataFrame(hits, columns=["qid", "fid"])

    return texts.mapInPandas(run, "qid long, fid long")


def reranked(candidates: DataFrame, k: int) -> DataFrame:
    """The k candidates of greatest pair_score; ties keep the candidates' order."""
    order = Window.partitionBy("qid").orderBy(F.desc("pair_score"), "rank")
    return candidates.withColumn("final_rank", F.row_number().over(order)).filter(F.col("final_rank") <= k)


def rerank_with(pairs: DataFrame, scorer_factory: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], k: int) -> DataFrame:
    """Score (qid, fid, rank, question, text) rows by an injected scorer, built once per task, and keep k per question."""
    def run(batches):
        scorer = scorer_factory()
        for pdf in batches:
            yield pdf[["qid", "fid", "rank"]].assign(pair_score=scorer(list(zip(pdf["question"], pdf["text"]))))

    return reranked(pairs.mapInPandas(run, "qid long, fid long, rank int, pair_score double"), k)


def hashing_encoder(dim: int = 64) -> Callable[[list[str], bool], np.ndarray]:
    """A deterministic encoder without a model: signed hashes of word pairs, as unit vectors."""
    import zlib

    def encode(texts: list[str], is_query: bool) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for p in pairs_of(t):
                h = zlib.crc32(p.encode())
                out[i, h % dim] += 1 if h >> 16 & 1 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def embedded(df: DataFrame, encoder_factory: Callable[[], Callable[[list[str], bool], np.ndarray]], is_query: bool = False, text: str = "text") -> DataFrame:
    """df with embedding array<float>; the encoder is built once per task and gets whole batches."""
    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches):
        encode = encoder_factory()
        for pdf in batches:
            yield pdf.assign(embedding=list(encode(pdf[text].fillna("").tolist(), is_query).astype(np.float32)))

    return df.mapInPandas(run, f"{named}, embedding array<float>")
