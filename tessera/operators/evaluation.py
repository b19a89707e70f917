"""How good a retrieval is: hits, recall, reciprocal rank, thresholds, bands, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import BANDS, THRESHOLDS
from tessera.functions.scores import percent, to_decimals
from tessera.functions.text import name_key


def first_hits(rankings: DataFrame, questions: DataFrame, k: int, runs: list[str]) -> DataFrame:
    """(run, qid, hit_rank) of every question and named run: the first rank up to k whose row is a hit, null if none."""
    best = rankings.filter(F.col("hit") & (F.col("rank") <= k)).groupBy("run", "qid").agg(F.min("rank").alias("hit_rank"))
    asked = questions.select("qid", F.explode(F.array(*map(F.lit, runs))).alias("run"))
    return asked.join(best, ["run", "qid"], "left")


def named_hits(rankings: DataFrame) -> DataFrame:
    """rankings with hit: whether a fragment's activity, tool or section is the expected name, case and accents aside."""
    wanted = name_key("expected")
    match = [name_key(c) == wanted for c in ("actividad", "herramienta", "seccion")]
    return rankings.withColumn("hit", (wanted != "") & (match[0] | match[1] | match[2]))


def metrics(hits: DataFrame) -> DataFrame:
    """recall (percent, one decimal), reciprocal rank (three decimals) and misses of each run."""
    return hits.groupBy("run").agg(
        F.count("*").alias("questions"),
        F.round(100.0 * F.count("hit_rank") / F.count("*"), 1).alias("recall"),
        F.round(F.sum(F.coalesce(1 / F.col("hit_rank"), F.lit(0.0))) / F.count("*"), 3).alias("mrr"),
        F.count_if(F.col("hit_rank").isNull()).alias("misses"),
    )


def page_hits(rankings: DataFrame, k: int) -> DataFrame:
    """(qid, page_hit): whether the expected page lies within one of the first k fragments."""
    inside = F.col("page").between(F.col("pagina_inicio"), F.col("pagina_fin"))
    return rankings.filter(F.col("rank") <= k).groupBy("qid").agg(F.max(F.coalesce(inside, F.lit(False))).alias("page_hit"))


def page_metrics(found: DataFrame, questions: DataFrame) -> DataFrame:
    """recall_page: percent of all questions (one decimal) whose expected page was hit; found is page_hits()'s result."""
    asked = questions.select("qid").join(found, "qid", "left")
    hit = F.count_if(F.coalesce("page_hit", F.lit(False)))
    return asked.agg(F.count("*").alias("questions"), F.round(100.0 * hit / F.count("*"), 1).alias("recall_page"), (F.count("*") - hit).alias("misses"))


def score_table(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, category, scores, best, hit_rank, hit_score): scores to four decimals (ties to even), best first."""
    score = to_decimals("score", 4)
    listed = F.array_sort(F.collect_list(F.struct("rank", score.alias("score"))))
    per = hits.groupBy("qid").agg(
        F.transform(listed, lambda x: x["score"]).alias("scores"), F.max(score).alias("best"),
        F.min(F.when(F.col("hit"), F.col("rank"))).alias("hit_rank"),
        F.min_by(score, F.when(F.col("hit"), F.col("rank"))).alias("hit_score"),
    )
    return questions.select("qid", "category").join(per, "qid", "left").withColumn("best", F.coalesce("best", F.lit(0.0)))


def _reached(score: str, steps: list[float]) -> Column:
    """How many of the rising steps a score reaches; 0 for null."""
    return F.coalesce(sum(((F.col(score) >= t).cast("int") for t in steps[1:]), (F.col(score) >= steps[0]).cast("int")), F.lit(0))


def sweep(scores: DataFrame, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """What each threshold rejects and keeps.

    Scores are read once into a histogram over the thresholds, whose few rows are then summed for each of them.
    """
    steps = sorted(thresholds)
    counted = scores.groupBy("category", _reached("best", steps).alias("best"), _reached("hit_score", steps).alias("kept")).agg(F.count("*").alias("n"))
    at = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(t).alias("umbral")) for i, t in enumerate(steps, 1))))
    each = counted.withColumn("at", at).select("*", "at.*")
    low, n = F.col("best") < F.col("i"), F.col("n")

    def total(test) -> Column:
        return F.sum(F.when(test, n).otherwise(F.lit(0)))

    inside, out, vague = (F.col("category") == c for c in ("respondible", "fuera", "ambigua"))
    return each.groupBy("umbral").agg(
        percent(total(out & low), total(out)).alias("rechazo_fuera"),
        percent(total(inside & low), total(inside)).alias("falsos_no_encuentro"),
        percent(total(inside & (F.col("kept") >= F.col("i"))), total(inside)).alias("recall"),
        total(vague & low).alias("ambiguas_rechazadas"),
    )


def safe(swept: DataFrame) -> DataFrame:
    """Thresholds that reject all out-of-scope questions and no answerable one."""
    ok = swept.filter("falsos_no_encuentro = 0 and rechazo_fuera = 100")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("umbral")), lambda x: F.format_number(x, 2)), ",")
    return ok.agg(F.count("*").alias("n"), F.min("umbral").alias("lowest"), F.max("umbral").alias("highest"), listed.alias("thresholds"))


def bands(scores: DataFrame, edges: list[float] = BANDS) -> DataFrame:
    """Answerable and out-of-scope questions by band [lo, hi) of the best score; empty bands stay."""
    inside, out = F.col("category") == "respondible", F.col("category") == "fuera"
    counted = scores.groupBy(_reached("best", edges).alias("band")).agg(
        F.count_if(inside).alias("respondibles"), F.count_if(inside & (F.col("hit_rank") == 1)).alias("first"), F.count_if(out).alias("fuera")
    )
    grid = scores.sparkSession.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate(zip(edges, edges[1:]), 1)], "band int, desde double, hi double")
    rows = grid.join(counted, "band", "left").fillna(0, ["respondibles", "first", "fuera"])
    return rows.select("desde", F.least("hi", F.lit(1.0)).alias("hasta"), "respondibles", percent(F.col("first"), F.col("respondibles")).alias("seccion_primera"), "fuera")


def class_gap(scores: DataFrame) -> DataFrame:
    """The weakest answerable and the strongest out-of-scope question; the smaller id on ties."""
    inside, out = F.col("category") == "respondible", F.col("category") == "fuera"
    low = F.min(F.when(inside, F.struct("best", "qid")))
    high = F.min(F.when(out, F.struct((-F.col("best")).alias("best"), "qid")))
    return scores.agg(low.alias("a"), high.alias("b")).select(
        F.col("a.qid").alias("weakest"), F.col("a.best").alias("weakest_score"), F.col("b.qid").alias("strongest"), (-F.col("b.best")).alias("strongest_score")
    )


def agreement(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Two rankings (qid, fid, rank, distance): percent with the same first k in order, with the same set, greatest gap."""
    both = a.select("qid", "fid", F.col("rank").alias("ra"), F.col("distance").alias("da")).join(
        b.select("qid", "fid", F.col("rank").alias("rb"), F.col("distance").alias("db")), ["qid", "fid"], "full"
    )
    per = both.groupBy("qid").agg(
        (F.count_if((F.least("ra", "rb") <= k) & ~F.col("ra").eqNullSafe(F.col("rb"))) == 0).alias("same_top"),
        (F.count_if(F.col("ra").isNull() | F.col("rb").isNull()) == 0).alias("same_set"),
        F.max(F.abs(F.col("da") - F.col("db"))).alias("gap"),
    )
    return per.agg(
        F.round(100.0 * F.count_if("same_top") / F.count("*"), 1).alias("same_top"), F.round(100.0 * F.count_if("same_set") / F.count("*"), 1).alias("same_set"),
        F.round(F.max("gap"), 6).alias("max_gap"), F.count_if(~F.col("same_top")).alias("differing"),
    )


def swapped(ranking: DataFrame) -> DataFrame:
    """A second store's ranking: the first two hits of even questions change places."""
    odd = F.when((F.col("qid") % 4 == 0) & (F.col("rank") <= 2), 3 - F.col("rank")).otherwise(F.col("rank"))
    return ranking.withColumn("rank", odd)
