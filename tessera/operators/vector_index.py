"""Vectors stored for search: by stage, so that a filter prunes what is read, and by cell with compressed codes.

Both layouts are Parquet tables whose partition column is what a question asks for; a search joins them with the few keys that its
questions have, and Spark prunes partitions by those keys at run time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scores import dot
from tessera.operators import retrieval
from tessera.operators.retrieval import FRAGMENT_BLOCK, NONE, QUESTION_BLOCK, _unit, nearest, pieces, ranked
from tessera.session import materialized

#: Bounds of a cell index: cells, rows that centres are fitted on for each, questions that probes are calibrated with.
MAX_CELLS, ROWS_PER_CELL, CALIBRATION = 4096, 64, 256
#: So many candidates for each neighbour asked for are scored again by their own vectors.
AGAIN = 4


def keyed_nearest(asked: DataFrame, rows: DataFrame, key: str, k: int, scale: str | None = None) -> DataFrame:
    """(qid, fid, score, rank): for each question the k best rows that share one of its keys, never the question itself.

    asked (key int, qid, qv), a stored table; rows (key, fid, fv), partitioned by key where pruning is wanted. With `scale`, fv is a
    binary of signed bytes, to be multiplied by that column. Up to QUESTION_BLOCK rows of asked are broadcast and rows stay where
    they are; more are dealt out in blocks of a key, and each pair of blocks is one group.
    """
    spark = asked.sparkSession
    schema = "qid long, fid long, score double"
    own = ["fid", "fv", *([scale] if scale else [])]
    # the comparison lets the optimizer take keys for a filter of the partitions that are read
    keys = asked.filter(F.col(key) >= 0).groupBy(key).agg(F.count("*").alias("asking"))
    rows = rows.select(key, *own)

    def vectors(pdf: pd.DataFrame) -> np.ndarray:
        if scale is None:
            return _unit(pdf["fv"])
        return np.stack([np.frombuffer(b, np.int8) for b in pdf["fv"]]) * pdf[scale].to_numpy(float)[:, None]

    def best_of(qids: np.ndarray, qv: np.ndarray, pdf: pd.DataFrame, best: dict) -> None:
        for part in pieces(pdf):
            mine = [best.get(q, NONE) for q in qids]
            retrieval.best_of(qids, qv, part["fid"].to_numpy(), vectors(part), mine, k)
            best.update(zip(qids, mine))

    def told(best: dict) -> pd.DataFrame:
        return retrieval.told(list(best), list(best.values()))

    if len(held := asked.filter(F.col(key) >= 0).select(key, "qid", "qv").limit(QUESTION_BLOCK + 1).collect()) <= QUESTION_BLOCK:
        by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for value in {r[0] for r in held}:
            mine = [r for r in held if r[0] == value]
            by[value] = np.array([r[1] for r in mine], np.int64), _unit([r[2] for r in mine])
        shipped = spark.sparkContext.broadcast(by)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for pdf in batches:
                for value, part in pdf.groupby(key):
                    best_of(*shipped.value[value], part, best)
            yield told(best)

        # at most QUESTION_BLOCK keys
        return ranked(rows.join(F.broadcast(keys.drop("asking")), key, "left_semi").mapInPandas(run, schema), k)

    sized = rows.join(keys, key).groupBy(key).agg(F.first("asking").alias("asking"), F.count("*").alias("there"))
    blocks = materialized(sized.select(key, F.ceil(F.col("asking") / QUESTION_BLOCK).cast("int").alias("qs"), F.ceil(F.col("there") / FRAGMENT_BLOCK).cast("int").alias("fs")), "blocks")

    def dealt(df: DataFrame, id_col: str, mine: str, count: str, other: str, others: str) -> DataFrame:
        out = df.join(blocks, key).withColumn(mine, F.pmod(F.xxhash64(id_col), F.col(count)).cast("int"))
        return out.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(others) - 1))).drop("qs", "fs").groupBy(key, "qb", "fb")

    def block(_, questions: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        best: dict = {}
        if len(questions) and len(part):
            best_of(questions["qid"].to_numpy(), _unit(questions["qv"]), part, best)
        return told(best)

    pairs = dealt(asked.select(key, "qid", "qv"), "qid", "qb", "qs", "fb", "fs").cogroup(dealt(rows, "fid", "fb", "fs", "qb", "qs"))
    return ranked(pairs.applyInPandas(block, schema), k)


# --- by stage --------------------------------------------------------------------------------------------------------


def write_by_stage(fragments: DataFrame, path: str) -> None:
    """Fragments (fid, fv, flabel) as a table partitioned by stage; null is stage 0. A stage of many rows is written by many tasks."""
    rows = fragments.withColumn("flabel", F.coalesce(F.col("flabel"), F.lit(0)).cast("int"))
    rows.repartitionByRange("flabel", "fid").write.mode("overwrite").partitionBy("flabel").parquet(path)


def nearest_in_stage(questions: DataFrame, path: str, k: int) -> DataFrame:
    """`nearest` over a table of write_by_stage; a question's stage (qlabel) decides which partitions are read for it.

    A fragment of another stage is never scored, and a stage that no question asks for is never read. Null and 0 filter nothing: those
    questions see all stages, in a pass of their own that takes place only if there are any.
    """
    spark = questions.sparkSession
    asked = materialized(questions.select("qid", "qv", F.coalesce(F.col("qlabel"), F.lit(0)).cast("int").alias("flabel")), "asked")
    rows = spark.read.schema("fid long, fv array<float>, flabel int").parquet(path)
    free = asked.filter("flabel = 0")
    out = keyed_nearest(asked.filter("flabel > 0"), rows, "flabel", k)
    return out if free.isEmpty() else out.unionByName(nearest(free, rows, k))


# --- by cell ---------------------------------------------------------------------------------------------------------


def _nearest_cells(v: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    return np.argsort(-(v @ centres.T), axis=1, kind="stable")[:, :n]


def write_cells(fragments: DataFrame, path: str, cells: int | None = None, recall: float = 0.95, k: int = 20, seed: int = 7) -> None:
    """An inverted file at `path`: rows by cell with codes of one byte a component, and the number of cells a question must probe.

    Centres are fitted by spherical k-means on at most ROWS_PER_CELL rows a cell, all rows are filed under their nearest centre. Codes
    are unit vectors in 255 steps of their own largest component. Probes are calibrated on CALIBRATION different vectors against exact search:
    the fewest cells that hold `recall` of their k neighbours. Vectors must be neither null nor zero.
    """
    spark = fragments.sparkSession
    n = fragments.count()
    cells = max(1, min(MAX_CELLS, cells or 1 << max(0, round(np.log2(3 * max(1.0, n) ** 0.5))), n))
    share = min(1.0, 1.2 * ROWS_PER_CELL * cells / max(1, n))
    vectors = fragments.filter(F.rand(seed) < share).limit(ROWS_PER_CELL * cells).select(array_to_vector(F.col("fv").cast("array<double>")).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=15, distanceMeasure="cosine").fit(vectors)
    centres = _unit(model.clusterCenters())
    shipped = spark.sparkContext.broadcast(centres)

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                v = _unit(pdf["fv"])
                top = np.abs(v).max(axis=1)
                codes = np.rint(v / top[:, None] * 127).astype(np.int8)
                yield pdf.assign(code=[c.tobytes() for c in codes], step=(top / 127).astype(np.float32), cell=_nearest_cells(v, shipped.value, 1)[:, 0])

    filed = fragments.select("fid", "fv", F.col("flabel").cast("int").alias("flabel")).mapInPandas(file, "fid long, fv array<float>, flabel int, code binary, step float, cell int")
    filed.repartitionByRange("cell", "fid").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    some = materialized(fragments.orderBy(F.xxhash64("fid", F.lit(seed)), "fid").limit(4 * CALIBRATION).select(F.col("fid").alias("qid"), F.col("fv").alias("qv")), "calibration")
    # different vectors: copies of one are found with a single probe
    some = materialized(some.dropDuplicates(["qv"]).orderBy(F.xxhash64("qid"), "qid").limit(CALIBRATION), "calibration")
    truth = nearest(some, fragments, k).join(_rows(spark, path).select("fid", "cell"), "fid").join(some, "qid").select("qid", "qv", "cell").collect()
    probes = 1
    if truth:
        order = np.argsort(_nearest_cells(_unit([r[1] for r in truth]), centres, len(centres)), axis=1)
        at = np.sort(order[np.arange(len(truth)), [r[2] for r in truth]])
        probes = int(at[min(len(at) - 1, int(np.ceil(recall * len(at))) - 1)]) + 1
    about = [(i, c.tolist(), probes) for i, c in enumerate(centres)]
    spark.createDataFrame(about, "cell int, centre array<double>, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("fid long, fv array<float>, flabel int, code binary, step float, cell int").parquet(f"{path}/rows")


def probed(questions: DataFrame, path: str, probes: int | None = None) -> DataFrame:
    """(qid, qv, cell) of the cells that each question probes."""
    spark = questions.sparkSession
    about = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    centres, n = np.array([r["centre"] for r in about]), probes or about[0]["probes"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                own = _nearest_cells(_unit(pdf["qv"]), centres, n)
                yield pdf.loc[pdf.index.repeat(own.shape[1])].assign(cell=own.ravel())

    return questions.select("qid", "qv").mapInPandas(run, "qid long, qv array<float>, cell int")


def search_cells(questions: DataFrame, path: str, k: int, probes: int | None = None) -> DataFrame:
    """Approximate `nearest` over a table of write_cells: codes of the probed cells pick AGAIN x k candidates, whose vectors decide."""
    asked = materialized(probed(questions, path, probes), "probed")
    rows = _rows(questions.sparkSession, path)
    rough = keyed_nearest(asked, rows.select("cell", "fid", F.col("code").alias("fv"), "step"), "cell", AGAIN * k, scale="step")
    found = materialized(rough.select("qid", "fid"), "candidates")
    # of the candidates' vectors, those in the cells that were probed at all
    wanted = rows.join(F.broadcast(asked.filter("cell >= 0").select("cell").distinct()), "cell", "left_semi").select("fid", "fv")
    cosine = F.round(dot(F.col("qv"), F.col("fv")) / F.sqrt(dot(F.col("qv"), F.col("qv")) * dot(F.col("fv"), F.col("fv"))), 6)
    scored = found.join(wanted, "fid").join(questions.select("qid", "qv"), "qid").select("qid", "fid", cosine.alias("score"))
    return ranked(scored, k)
