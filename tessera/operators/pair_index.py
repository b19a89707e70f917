"""Exact top-k by shared word pairs over a stored index, in which frequent pairs of long fragments are not read.

Postings lie in partitions by band: fragments of about equal numbers of pairs. A small directory tells for every pair and band how many
postings there are. A question first reads the bands of the shortest fragments, where one shared pair weighs most, and so learns a score
that its k-th best reaches at least. In each other band that score asks for a number of shared pairs: fragments that have so many must
hold one of the question's rarer pairs there, so only those are read; a band where the question hasn't as many pairs is not read at all.
What could still get in is looked up in the frequent pairs by fragment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import retrieval
from tessera.session import materialized

#: Share of a question's postings that the first bands hold, about.
FIRST = 0.1
#: Scores are rounded to 6 decimals: a greater score is at least so much less than the rounded one.
HALF = 5e-7
POSTING = "pair string, fid long, nf long, band int"


def _band(nf: Column) -> Column:
    """Two bands for each doubling of the number of pairs."""
    return F.floor(2 * F.log2(F.greatest(nf, F.lit(1)))).cast("int")


def write_by_length(fragments: DataFrame, path: str, fid: str = "doc_id") -> None:
    """Postings of (fid, text) by band, and the directory (pair, band, n, lo). Ids must be unique.

    Null texts and texts of fewer than two words have no postings.
    """
    rows = retrieval.postings(fragments, fid).select("pair", "fid", "nf", _band(F.col("nf")).alias("band"))
    # from where texts are read: a search joins on pairs, which an order by pair or a shuffle wouldn't spare it to read
    rows.write.mode("overwrite").partitionBy("band").parquet(f"{path}/postings")
    own = fragments.sparkSession.read.schema(POSTING).parquet(f"{path}/postings")
    own.groupBy("pair", "band").agg(F.count("*").alias("n"), F.min("nf").alias("lo")).write.mode("overwrite").parquet(f"{path}/directory")


def _shared(wanted: DataFrame, postings: DataFrame, on: list[str]) -> DataFrame:
    return wanted.join(postings, on).groupBy("qid", "fid", "nq", "nf").agg(F.count("*").alias("shared"))


def search(questions: DataFrame, path: str, k: int, qid: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """Candidates exactly as `retrieval.lexical` finds them, and (step, postings): how many postings each step reads.

    Steps: all (every posting of the questions' pairs, for comparison), first, rare, and looked_up (at most so many). Nothing but that
    report's four numbers depends on a count at the driver, save whether pairs are broadcast (up to retrieval.PAIRS_SHIPPED of them, so that
    postings of others leave no task); a question's plan has a row for each of its pairs and bands.
    """
    spark: SparkSession = questions.sparkSession
    postings = spark.read.schema(POSTING).parquet(f"{path}/postings")
    directory = spark.read.parquet(f"{path}/directory")
    asked = retrieval.asked(questions, qid)
    own = retrieval.shipped(asked)
    if own is not None:
        postings, directory = (x.join(F.broadcast(own), "pair", "left_semi") for x in (postings, directory))
    plan = asked.join(directory, "pair")
    bands = plan.groupBy("qid", "band").agg(F.sum("n").alias("n_band"), F.count("*").alias("own"), F.min("lo").alias("lo"))
    ahead = F.coalesce(F.sum("n_band").over(Window.partitionBy("qid").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bands = bands.withColumn("first", ahead < F.greatest(F.lit(k), FIRST * F.sum("n_band").over(Window.partitionBy("qid"))))
    plan = materialized(plan.drop("lo").join(bands, ["qid", "band"]), "plan")
    first = plan.filter("first")
    best = materialized(retrieval.ranked(retrieval.pair_scores(_shared(first.select("qid", "nq", "pair", "band"), postings, ["pair", "band"])), k), "first")
    least = best.filter(F.col("rank") == k).select("qid", F.col("score").alias("least"))
    # fewer than k found: any shared pair will do
    rest = plan.filter("not first").join(least, "qid", "left").fillna(0.0, ["least"])
    # `lo` is the least of the question's pairs in the band, so no fragment that shares one has fewer
    need = F.greatest(F.lit(1), F.ceil((F.col("least") - HALF) * F.sqrt(F.col("nq") * F.col("lo")) - 1e-9))
    place = F.row_number().over(Window.partitionBy("qid", "band").orderBy("n", "pair"))
    rest = rest.withColumn("need", need).filter("need <= own").withColumn("rare", place <= F.col("own") - F.col("need") + 1)
    rest = materialized(rest, "rest")
    rare = rest.filter("rare").select("qid", "nq", "pair", "band", "need", "least")
    partial = rare.join(postings, ["pair", "band"]).groupBy("qid", "fid", "nq", "nf", "band", "need", "least").agg(F.count("*").alias("some"))
    could = (F.col("some") + F.col("need") - 1) / F.sqrt(F.col("nq") * F.col("nf")) >= F.col("least") - HALF - 1e-12
    partial = materialized(partial.filter(could), "partial")
    frequent = rest.filter("not rare").select("qid", "band", "pair")
    looked = partial.filter("need > 1").select("qid", "band", "fid").join(frequent, ["qid", "band"])
    more = looked.join(postings.select("pair", "band", "fid"), ["pair", "band", "fid"]).groupBy("qid", "fid").agg(F.count("*").alias("more"))
    late = partial.join(more, ["qid", "fid"], "left").select("qid", "fid", "nq", "nf", (F.col("some") + F.coalesce("more", F.lit(0))).alias("shared"))
    hits = retrieval.ranked(best.drop("rank").unionByName(retrieval.pair_scores(late)), k)

    def step(name: str, of: DataFrame, n: Column) -> DataFrame:
        return of.agg(F.lit(name).alias("step"), F.coalesce(n, F.lit(0)).cast("long").alias("postings"))

    report = step("all", plan, F.sum("n")).unionByName(step("first", first, F.sum("n"))).unionByName(step("rare", rest.filter("rare"), F.sum("n")))
    return hits, report.unionByName(step("looked_up", partial, F.sum(F.col("need") - 1)))
